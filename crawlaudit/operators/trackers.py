"""Tracker detection: catalog matches, evidence, rows and status."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..catalog import patterns as P, trackers as C
from ..functions import urls as U
from .skew import lookup_join
from .containers import read_containers, scan_containers

# Status ladder, weakest first, and the evidence kind behind each.
STATUSES = ["gtm-only", "in-page", "loaded", "sending"]
KIND_RANK = {"container": 1, "code": 2, "loaded": 3, "hit": 4}
STATUS_LABEL = {"sending": "Sending", "loaded": "Loaded, not sending", "in-page": "In the page, not loaded", "gtm-only": "In GTM only"}


# What placeholders look like.
PLACEHOLDERS = [r"(?i)^x+\z", r"^(.)\1+\z", "^(?:0?123456789|1234567)"]


def valid_id(id_: Column, format_: Column, formats: list[str]) -> Column:
    """Right shape and not a placeholder: all x, one repeated character, 1234567....

    ``formats`` lists the values that ``format_`` may have, so that each is a pattern of its own, compiled once.
    """
    body = F.regexp_replace(F.regexp_replace(id_, "^[A-Z]{1,3}-", ""), "[-_]", "")
    shape = F.lit(False)
    for known in formats:
        shape = F.when(format_ == known, id_.rlike(rf"^(?:{known})\z")).otherwise(shape)
    for fake in PLACEHOLDERS:
        shape = shape & ~body.rlike(fake)
    return F.coalesce(shape, F.lit(False))


def _parts(signals: DataFrame, requests: DataFrame | None) -> DataFrame:
    """What patterns are matched on: (page_id, kind, seq, use, value, url).

    Script addresses also yield attribute text; requests count as kind ``resource``.
    """
    code = signals.where("kind in ('inline', 'noscript')").select("page_id", "kind", "seq", F.lit("code").alias("use"), "value", F.lit(None).cast("string").alias("url"))
    url = signals.where("kind in ('script', 'iframe')").select("page_id", "kind", "seq", F.lit("url").alias("use"), "value", F.col("value").alias("url"))
    attrs = F.concat("key", F.lit(' src="'), "value", F.lit('"'))
    tag = signals.where("kind = 'script' and key <> ''").select("page_id", "kind", "seq", F.lit("tag").alias("use"), attrs.alias("value"), F.col("value").alias("url"))
    parts = code.unionByName(url).unionByName(tag)
    if requests is None:
        return parts
    return parts.unionByName(requests.select("page_id", F.lit("resource").alias("kind"), "seq", F.lit("url").alias("use"), F.col("url").alias("value"), "url"))


def _matched(parts: DataFrame, catalog: list[dict] | None, outer: bool = False) -> DataFrame:
    """Matches of parts with their prefixed id (T3); a match with an invalid id is dropped, or with ``outer`` loses its tracker."""
    spark = parts.sparkSession
    hits = P.match(parts, [r for r in C.pattern_rows(catalog) if r["use"] != "container"], C.PATTERN_SCHEMA, outer)
    meta = C.tracker_table(spark, catalog).select("tracker", "format", "ran", "sends")
    hits = hits.join(F.broadcast(meta), "tracker", "left")
    raw = F.col("found")
    full = F.when(F.col("prefix").isNotNull() & ~F.startswith(raw, F.col("prefix")), F.concat("prefix", raw)).otherwise(raw)
    hits = hits.withColumn("id", full)
    good = F.col("id").isNull() | valid_id(F.col("id"), F.col("format"), C.formats(catalog))
    return hits.withColumn("tracker", F.when(good, F.col("tracker"))) if outer else hits.where(good)


def tracker_matches(signals: DataFrame, requests: DataFrame | None = None, catalog: list[dict] | None = None) -> DataFrame:
    """Every valid match of every signal (T4): kind, seq, tracker, part, label, id, positions."""
    return _matched(_parts(signals, requests), catalog)


_READY = "struct<tracker:string,kind:string,label:string,id:string,variable:boolean,src_ord:int>"


def _ready(df: DataFrame) -> DataFrame:
    item = F.struct("tracker", "kind", "label", "id", "variable", "src_ord").cast(_READY)
    text = F.lit(None).cast("string")
    return df.select("page_id", F.lit("ready").alias("kind"), F.lit(0).alias("seq"), F.lit("").alias("use"), text.alias("value"), text.alias("url"), item.alias("ready"))


def evidence(signals: DataFrame, requests: DataFrame | None = None, runtime: DataFrame | None = None,
             containers: DataFrame | None = None, catalog: list[dict] | None = None) -> DataFrame:
    """One row per distinct (page, tracker, kind, label, id).

    Everything a page offers goes into one table with a tag and is dealt by page once. What follows - which address
    matched first (T5), which script was loaded, which library never ran (T10), distinct evidence, and the rows of
    :func:`tracker_rows` - are windows and groups within a page, which that dealing serves without another shuffle.
    """
    spark = signals.sparkSession
    parts = _parts(signals, requests)
    if runtime is not None:
        ran = runtime.where("space = 'ran' and value = 'false'")
        parts = parts.unionByName(ran.select("page_id", F.lit("ran").alias("kind"), F.lit(0).alias("seq"), F.lit("").alias("use"), F.col("key").alias("value"), F.lit(None).cast("string").alias("url")))
    parts = parts.withColumn("ready", F.lit(None).cast(_READY))
    if runtime is not None:
        parts = parts.unionByName(_ready(_live_evidence(spark, runtime, catalog)))
    if containers is not None:
        parts = parts.unionByName(_ready(_container_evidence(signals, requests, containers, catalog)))
    rows = _matched(parts.repartition("page_id"), catalog, outer=True)
    kind, use = F.col("kind"), F.col("use")
    # A request tries hits first, an element src first.
    late = F.when(kind == "resource", F.col("part") != "hits").otherwise(F.col("part") != "src")
    rows = rows.withColumns({
        "_key": U.strip_hash_text(F.col("url")), "_ran": F.when(kind == "ran", F.col("value")).otherwise(F.col("ran")),
        "_rank": F.when(F.col("tracker").isNotNull() & (use == "url"), F.struct(late.alias("late"), "pat_ord", "match_pos")),
    })
    within = lambda *more: W.partitionBy("page_id", *more)
    rows = rows.withColumns({
        "_first": F.min("_rank").over(within("kind", "seq", "use", "tracker")),
        "_loaded": F.coalesce(F.max(kind == "resource").over(within("_key")) & F.col("_key").isNotNull(), F.lit(False)) if requests is not None else F.lit(False),
        "never_ran": F.coalesce(F.max(kind == "ran").over(within("_ran")) & F.col("_ran").isNotNull(), F.lit(False)) if runtime is not None else F.lit(False),
    })
    rows = rows.where((F.col("tracker").isNotNull() & (F.col("_rank").isNull() | (F.col("_rank") == F.col("_first")))) | F.col("ready").isNotNull())
    hit, never, loaded = F.col("part") == "hits", F.col("never_ran"), F.col("_loaded")
    script = F.when(kind == "script", " script in the page, not loaded").otherwise(" iframe in the page, not loaded")
    item = lambda k, label, src, pat=F.col("pat_ord"): F.struct(
        F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), label.alias("label"), F.lit(src).alias("src_ord") if isinstance(src, int) else src.alias("src_ord"), pat.alias("pat_ord"))
    found = (
        F.when(kind == "resource", item(
            F.when(hit, "hit").when(never, "code").otherwise("loaded"),
            F.when(hit, F.concat(F.lit("hit to "), "label")).when(never, F.concat("label", F.lit(" requested, never ran (blocked?)"))).otherwise(F.concat("label", F.lit(" loaded"))), 0))
        .when((use == "url") & ~loaded, item("code", F.concat("label", script), F.when(kind == "script", 1).otherwise(2)))
        .when(use == "tag", item(F.when(loaded, "loaded").otherwise("code"), F.concat(F.lit("script "), "label"), 1, F.col("pat_ord") + 100))
        .when(use == "code", item("code", F.concat("kind", F.lit(" "), "label"), F.when(kind == "inline", 3).otherwise(4)))
    )
    rows = rows.withColumn("_e", found).where(F.col("_e").isNotNull() | F.col("ready").isNotNull())
    own = lambda c, d: F.coalesce(F.col(f"ready.{c}"), d).alias(c)
    rows = rows.select(
        "page_id", own("tracker", F.col("tracker")), own("kind", F.col("_e.kind")), own("label", F.col("_e.label")), F.when(F.col("ready").isNotNull(), F.col("ready.id")).otherwise(F.col("id")).alias("id"),
        own("variable", F.lit(False)), own("src_ord", F.col("_e.src_ord")), "seq", F.coalesce("_e.pat_ord", F.lit(0)).alias("pat_ord"), F.coalesce("match_pos", F.lit(0)).alias("match_pos"),
    )
    order = F.min(F.struct("src_ord", "seq", "pat_ord", "match_pos")).alias("pos")
    return rows.groupBy("page_id", "tracker", "kind", "label", "id", "variable").agg(order)


def _live_evidence(spark, runtime: DataFrame, catalog) -> DataFrame:
    live = C.live_table(spark, catalog)
    state = runtime.where("space = 'tracker'").select("page_id", "key", "value")
    joined = state.join(F.broadcast(live), "key")
    is_global = F.startswith("key", F.lit("global:"))
    kept = joined.where(is_global | valid_id(F.col("value"), F.col("format"), C.formats(catalog)))
    return kept.select(
        "page_id", "tracker", "kind", "label", F.when(~is_global, F.col("value")).alias("id"), F.lit(False).alias("variable"),
        F.lit(5).alias("src_ord"), F.lit(0).alias("seq"), F.lit(0).alias("pat_ord"), F.lit(0).alias("match_pos"),
    )


def named_containers(signals: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(page_id, container_id) for the containers a page names in code or loads, known or not."""
    named = signals.where("kind in ('script', 'inline', 'noscript', 'iframe')").select("page_id", "value")
    if requests is not None:
        named = named.unionByName(requests.select("page_id", F.col("url").alias("value")))
    ids = F.array_distinct(F.regexp_extract_all("value", F.lit(r"(?<![A-Za-z0-9])(GTM-[A-Z0-9]{4,10})"), F.lit(1)))
    return named.select("page_id", F.explode(ids).alias("container_id")).distinct()


def page_containers(signals: DataFrame, requests: DataFrame | None, containers: DataFrame) -> DataFrame:
    """(page_id, container_id) for the containers a page names that are there to read."""
    ids = named_containers(signals, requests)
    return lookup_join(ids, containers.select("container_id").distinct(), ["container_id"], "inner").select("page_id", "container_id")


def _container_evidence(signals, requests, containers, catalog) -> DataFrame:
    scanned = scan_containers(read_containers(containers), catalog)
    pages = named_containers(signals, requests)
    # A container that a third of all pages load is spread like any hot key.
    return lookup_join(pages, scanned, ["container_id"], "inner").select(
        "page_id", "tracker", F.lit("container").alias("kind"), F.concat("label", F.lit(" in "), "container_id").alias("label"),
        "id", "variable", F.lit(6).alias("src_ord"), F.lit(0).alias("seq"), F.lit(0).alias("pat_ord"), F.lit(0).alias("match_pos"),
    )


def tracker_rows(found: DataFrame, catalog: list[dict] | None = None) -> DataFrame:
    """One row per (page, tracker, id) with status and ordered evidence.

    The evidence of one tracker on one page is bounded by the page, so the rules about
    evidence without an id run on one array per (page, tracker).
    """
    spark = found.sparkSession
    rank = F.lit(0)
    for kind, r in KIND_RANK.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    item = F.struct((-rank).alias("kind_ord"), "pos", "kind", "label", "id", "variable", rank.alias("rank"))
    per = found.groupBy("page_id", "tracker").agg(F.array_sort(F.collect_list(item)).alias("ev"))
    ids_of = lambda cond: F.array_distinct(F.transform(F.filter("ev", lambda e: e["id"].isNotNull() & cond(e)), lambda e: e["id"]))
    per = per.withColumns({"_ids": ids_of(lambda e: F.lit(True)), "_page_ids": ids_of(lambda e: e["kind"] != "container")})
    no_id = lambda e: e["id"].isNull()
    general = F.filter("ev", lambda e: no_id(e) & ~e["variable"])
    variable = F.filter("ev", lambda e: no_id(e) & e["variable"])
    per = per.withColumns({"_general": general, "_variable": variable})
    n_page = F.size("_page_ids")
    null_row = ((F.size("_general") > 0) & (n_page == 0)) | ((F.size("_variable") > 0) & (n_page != 1))
    targets = F.concat("_ids", F.when(null_row, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    rows = per.withColumn("id", F.explode(targets))
    on_page = F.array_contains("_page_ids", F.coalesce("id", F.lit("")))
    takes_general = F.when(F.col("id").isNull(), n_page == 0).otherwise(on_page)
    takes_variable = F.when(F.col("id").isNull(), n_page != 1).otherwise(on_page & (n_page == 1))
    mine = F.filter(
        "ev",
        lambda e: F.when(e["id"].isNotNull(), F.coalesce(e["id"] == F.col("id"), F.lit(False)))
        .when(e["variable"], takes_variable).otherwise(takes_general),
    )
    rows = rows.select("page_id", "tracker", "id", mine.alias("ev")).join(F.broadcast(C.tracker_table(spark, catalog)), "tracker")
    top = F.array_max(F.transform("ev", lambda e: e["rank"]))
    top = F.when((top == 4) & ~F.col("sends"), 3).otherwise(top)
    has_var = F.exists("ev", lambda e: e["variable"])
    text = lambda e: F.when(e["variable"], F.concat(e["label"], F.lit(" (ID set by a GTM variable)"))).otherwise(e["label"])
    w = W.partitionBy("page_id").orderBy("group_ord", "cat_ord", F.col("status_rank").desc(), F.coalesce("id", F.lit("")))
    out = rows.select(
        "page_id", "tracker", "name", "short", "group", "group_ord", "cat_ord", "id",
        F.when(F.col("id").isNull() & ~F.col("no_id"), F.when(has_var, "ID set by a GTM variable").otherwise("No ID found")).alias("id_note"),
        top.alias("status_rank"), F.get(F.array(*[F.lit(s) for s in STATUSES]), top - 1).alias("status"),
        "sends", "retired", F.transform("ev", text).alias("evidence"),
    )
    return out.withColumn("row_no", F.row_number().over(w))


def detect_trackers(signals: DataFrame, requests=None, runtime=None, containers=None, catalog=None) -> DataFrame:
    """Tracker rows of a crawl from its signals and optional side tables.

    ``signals`` is read by several stages: pass a staged table (``staged_signals``).
    """
    return tracker_rows(evidence(signals, requests, runtime, containers, catalog), catalog)


def coverage(signals: DataFrame, requests: DataFrame | None = None, runtime: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """What was checked on each page (T15); ``capped`` says that a list reached the limit it was collected with."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = signals.groupBy("page_id").agg(n("script").alias("scripts"), n("inline").alias("inline"), n("noscript").alias("noscript"))
    if requests is None:
        out = out.withColumn("resources", F.lit(0).cast("long"))
    else:
        res = requests.groupBy("page_id").agg(F.count_distinct("url").alias("resources"))
        out = out.join(res, "page_id", "full").na.fill(0, ["scripts", "inline", "noscript", "resources"])
    full = [F.col(k) >= limits[k] for k in ("scripts", "noscript") if k in (limits or {})]
    out = out.withColumn("capped", reduce(or_, full, F.lit(False)))
    if runtime is None:
        return out.withColumn("live", F.lit(False))
    live = runtime.select("page_id", F.lit(True).alias("live")).distinct()
    return out.join(live, "page_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))


def status_label(rows: DataFrame) -> DataFrame:
    """Readable status; trackers that never send are just loaded."""
    label = F.when((F.col("status") == "loaded") & ~F.col("sends"), "Loaded")
    for s, text in STATUS_LABEL.items():
        label = label.when(F.col("status") == s, text)
    return rows.withColumn("status_label", label)


def status_counts(rows: DataFrame, by: str = "page_id") -> DataFrame:
    """Rows per status."""
    return rows.groupBy(by, "status").agg(F.count("*").alias("n"))


def tracker_chips(rows: DataFrame) -> DataFrame:
    """One chip per tracker, Meta Pixel one per id, with its best status."""
    per_id = F.col("tracker") == "meta"
    key = F.when(per_id, F.concat("tracker", F.lit("|"), F.coalesce("id", F.lit("")))).otherwise(F.col("tracker"))
    label = F.when(per_id & F.col("id").isNotNull(), F.concat("short", F.lit(" "), "id")).otherwise(F.col("short"))
    chips = rows.groupBy("page_id", key.alias("key")).agg(
        F.min("tracker").alias("tracker"), F.min_by(label, "row_no").alias("label"), F.max("status_rank").alias("rank"),
        F.min("group").alias("group"), F.min("row_no").alias("ord"),
    )
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("rank") - 1)
    return chips.select("page_id", "key", "tracker", "label", status.alias("status"), "group", "ord")
