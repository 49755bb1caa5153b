"""Tag-manager containers (S9, T6-T9): configured identifiers per container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..catalog import patterns as P, trackers as C
from ..functions import jsontext as J
from ..functions.text import let

_MARK = "var data = "


def container_data(text: Column) -> Column:
    """The container's data object as JSON, NULL when it cannot be read.

    The object ends where the bracket that opens it closes: the tokens up to there are its text.
    """
    at = F.position(F.lit(_MARK), text)
    tail = F.substring(text, F.position(F.lit("{"), F.substring(text, at, F.length(text))) + at - 1, F.length(text))

    def first_object(ts: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        step = lambda acc, t: F.when(acc["done"], acc).otherwise(
            let(acc["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0),
                lambda d: F.struct(d.alias("depth"), (acc["n"] + 1).alias("n"), (d == 0).alias("done"))))
        return let(F.aggregate(ts, start, step), lambda e: F.when(e["done"], F.array_join(F.slice(ts, 1, F.greatest(e["n"], F.lit(1))), "")))

    found = F.when((at > 0) & tail.startswith("{"), let(J.tokens(tail), first_object))
    return let(found, lambda j: F.when(J.is_valid(j), j))


def resolve_constants(text: Column) -> Column:
    """Inline references to constant variables by their quoted value.

    The text is cut at its references; each is put back as the value of the constant, or as it was.
    """
    reference = r'\["macro",\s*(\d+)\]'
    macros = F.from_json(F.get_json_object(container_data(text), "$.resource.macros"), "array<struct<function:string,vtp_value:string>>")

    def filled(m: Column) -> Column:
        refs = F.regexp_extract_all(text, F.lit(reference), F.lit(0))
        rest = F.split(text, reference)
        value = lambda r: let(F.get(m["known"], F.regexp_extract(r, reference, 1).try_cast("int")), lambda x: F.when((x["function"] == "__c") & x["vtp_value"].isNotNull(), J.quoted(x["vtp_value"])))
        puts = F.transform(refs, lambda r: F.coalesce(value(r), r))
        return F.array_join(F.zip_with(rest, puts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(macros.isNull(), text).otherwise(let(F.struct(macros.alias("known")), filled))


def valid_container_url(url):
    """Only gtm.js addresses with a container id are accepted."""
    return url.rlike(r"(?i)^https?://[^/?#]+[^?#]*/gtm\.js\?(?:[^#]*&)?id=(?-i:GTM-[A-Z0-9]+)(?:[&#]|\z)")


def read_containers(containers: DataFrame) -> DataFrame:
    """Usable containers, one per id, constants resolved."""
    ok = containers.where(F.col("text").isNotNull() & valid_container_url(F.col("url")))
    one = ok.groupBy("container_id").agg(F.min_by("text", "url").alias("text"))
    return one.select("container_id", resolve_constants(F.col("text")).alias("text"))


def template_injects(texts: DataFrame, host: str) -> DataFrame:
    """(container_id, fn) of custom templates allowed to inject a script from ``host``."""
    pieces = texts.select("container_id", F.explode(F.split("text", r'(?="__cvt_[A-Za-z0-9_]+":\{)')).alias("piece"))
    block = F.replace(F.regexp_extract("piece", r'(?s)^(.*?)(?:\n"__|\z)', 1), F.lit("\\/"), F.lit("/"))
    fn = F.regexp_extract("piece", r'^"(__cvt_[A-Za-z0-9_]+)":\{', 1)
    allowed = block.contains("inject_script") & block.rlike(host)
    return pieces.where((fn != "") & allowed).select("container_id", fn.alias("fn")).distinct()


def scan_containers(texts: DataFrame, catalog: list[dict] | None = None) -> DataFrame:
    """(container_id, tracker, id, label, variable) each container configures.

    ``texts`` comes from ``read_containers``. Containers are cut at tag boundaries, so
    a pattern never crosses into the next tag and long files spread over rows.
    """
    from .trackers import valid_id

    spark = texts.sparkSession
    pats = [r for r in C.pattern_rows(catalog) if r["use"] == "container"]
    parts = texts.select(
        "container_id", F.lit("container").alias("use"), F.posexplode(F.split("text", r'(?="function":)')).alias("seq", "value")
    )
    hits = P.match(parts, pats, C.PATTERN_SCHEMA).join(F.broadcast(C.tracker_table(spark, catalog)), "tracker")
    full = F.when(F.col("prefix").isNotNull() & ~F.startswith("found", F.col("prefix")), F.concat("prefix", "found")).otherwise(F.col("found"))
    ids = hits.where("part <> 'var' and found is not null").withColumn("id", full).where(valid_id(F.col("id"), F.col("format"), C.formats(catalog)))
    ids = ids.where(~((F.col("tracker") == "gtm") & (F.col("id") == F.col("container_id"))))
    first = F.min(F.struct((F.col("part") != "code").alias("late"), "pat_ord", "seq", "match_pos", "label"))
    found = ids.groupBy("container_id", "tracker", "id").agg(first["label"].alias("label"), F.lit(False).alias("variable"))

    var = hits.where("part = 'var'")
    free = var.where(F.col("template").isNull())
    for host in sorted({t["template"] for t in catalog or C.TRACKERS if t.get("template")}):
        allowed = template_injects(texts, host).withColumnRenamed("fn", "found")
        free = free.unionByName(var.where(F.col("template") == host).join(allowed, ["container_id", "found"], "left_semi").select(*free.columns))
    variables = free.groupBy("container_id", "tracker").agg(F.min("label").alias("label"))
    return found.unionByName(
        variables.select("container_id", "tracker", F.lit(None).cast("string").alias("id"), "label", F.lit(True).alias("variable"))
    )


def container_targets(signals: DataFrame, requests: DataFrame | None, rows: DataFrame, per_page: int | None = None) -> DataFrame:
    """(page_id, id, url) of containers to fetch: exact loader addresses first.

    ``per_page`` limits the fetch list of one page.
    """
    from .trackers import valid_id

    loader = r"""/gtm\.js\?(?:[^#\s"'<>]*?&)?id=(GTM-[A-Z0-9]{4,10})(?![A-Z0-9])"""
    urls = signals.where("kind = 'script'").select("page_id", F.lit(1).alias("prio"), F.col("seq").cast("long"), F.col("value").alias("url"))
    if requests is not None:
        urls = requests.select("page_id", F.lit(0).alias("prio"), F.col("seq").cast("long"), "url").unionByName(urls)
    exact = urls.withColumn("id", F.regexp_extract("url", loader, 1)).where(
        F.col("url").rlike("(?i)^https?://") & valid_id(F.col("id"), F.lit("GTM-[A-Z0-9]{4,10}"), ["GTM-[A-Z0-9]{4,10}"])
    )
    default = rows.where("tracker = 'gtm' and id is not null and status <> 'gtm-only'").select(
        "page_id", F.lit(2).alias("prio"), F.col("row_no").cast("long").alias("seq"),
        F.concat(F.lit("https://www.googletagmanager.com/gtm.js?id="), "id").alias("url"), "id",
    )
    best = exact.unionByName(default).groupBy("page_id", "id").agg(F.min(F.struct("prio", "seq", "url")).alias("b"))
    if per_page is not None:
        w = W.partitionBy("page_id").orderBy("b.prio", "b.seq")
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_page)
    return best.select("page_id", "id", F.col("b.url").alias("url"))
