"""Technology detection: evidence, implied rows, version pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..catalog import patterns as P, tech as C
from ..functions import text as T, versions as V
from ..sources.tables import newest

_FIELDS = ("page_id", "tech", "text", "version", "rank", "likely", "src_ord", "pat_ord", "seq")


def valid_version(v: Column) -> Column:
    return F.when(V.is_version(v), v)


def page_urls(signals: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(page_id, seq, value): distinct script, stylesheet and request addresses, in that order."""
    urls = signals.where("kind in ('script', 'link')").select(
        "page_id", F.struct(F.when(F.col("kind") == "script", 0).otherwise(1).alias("k"), F.col("seq")).alias("pos"), "value"
    )
    if requests is not None:
        urls = urls.unionByName(requests.select("page_id", F.struct(F.lit(2).alias("k"), F.col("seq")).alias("pos"), F.col("url").alias("value")))
    urls = urls.where(F.col("value") != "").repartition("page_id").groupBy("page_id", "value").agg(F.min("pos").alias("pos"))
    return urls.select("page_id", (F.col("pos.k").cast("long") * 10_000_000 + F.col("pos.seq")).alias("seq"), "value")


def page_headers(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """(page_id, header, value) of each page's own response, names lower-case."""
    own = pages.select("page_id", "url").join(newest(responses.where("error is null").select("url", "headers"), "url"), "url")
    return own.select("page_id", F.explode("headers").alias("header", "value")).withColumn("header", F.lower("header"))


def base_evidence(signals: DataFrame, requests: DataFrame | None = None, headers: DataFrame | None = None,
                  runtime: DataFrame | None = None, catalog=None, url_hits: int | None = None, urls: DataFrame | None = None) -> DataFrame:
    """Evidence lines from every source the page itself offers (G2); ``url_hits`` limits addresses per pattern.

    ``urls`` is the result of :func:`page_urls` where there is one already.
    """
    spark = signals.sparkSession
    texts = signals.where("kind in ('generator', 'inline', 'comment', 'body')").select("page_id", F.col("kind").alias("use"), F.col("seq").cast("long"), "value")
    urls = page_urls(signals, requests) if urls is None else urls
    texts = texts.unionByName(urls.select("page_id", F.lit("url").alias("use"), "seq", "value"))
    hits = P.match(texts, C.pattern_rows(catalog), C.PATTERN_SCHEMA)
    if url_hits is not None:
        w = W.partitionBy("page_id", "tech", "use", "pat_ord").orderBy("seq")
        hits = hits.withColumn("_n", F.row_number().over(w)).where((F.col("use") != "url") | (F.col("_n") <= url_hits))
    quoted = lambda lead, body, n: F.concat(F.lit(f'{lead} "'), T.clip(body, n), F.lit('"'))
    text = (
        F.when(F.col("use") == "generator", quoted("generator", F.col("value"), 80))
        .when(F.col("use") == "comment", quoted("comment", F.col("value"), 80))
        .when(F.col("use") == "body", quoted("body class", F.col("matched"), 60))
        .when(F.col("use") == "url", F.concat("label", F.lit(": "), T.short_url(F.col("value"))))
        .otherwise(F.concat("label", F.coalesce(F.concat(F.lit(" ("), "found", F.lit(")")), F.lit(""))))
    )
    order = F.create_map(*[x for i, u in enumerate(("generator", "url", "inline", "comment")) for x in (F.lit(u), F.lit(i))])
    out = hits.select(
        "page_id", "tech", text.alias("text"), valid_version(F.col("found")).alias("version"), "rank", F.lit(False).alias("likely"),
        F.coalesce(order[F.col("use")], F.lit(5)).alias("src_ord"), "pat_ord", "seq",
    )
    if headers is not None:
        j = P.match_parts(headers, C.header_rows(catalog))
        out = out.unionByName(j.select(
            "page_id", "tech", F.concat("header", F.lit(": "), T.clip(F.col("value"), 70)).alias("text"), valid_version(F.col("found")).alias("version"),
            F.lit(C.RANK["header"]).alias("rank"), F.lit(False).alias("likely"), F.lit(4).alias("src_ord"), "pat_ord", F.lit(0).cast("long").alias("seq"),
        ))
    dom = signals.where("kind = 'dom'").select("page_id", "key", "value").join(F.broadcast(C.key_table(spark, "dom", catalog)), "key")
    shown = F.concat("label", F.lit(' "'), T.clip(F.col("value"), 40), F.lit('"'))
    out = out.unionByName(_keyed(dom, shown, 6))
    if runtime is not None:
        live = runtime.where("space = 'tech'").select("page_id", "key", "value").join(F.broadcast(C.key_table(spark, "live", catalog)), "key")
        live = live.where(~F.col("is_version") | (F.coalesce("value", F.lit("")) != ""))
        out = out.unionByName(_keyed(live, F.concat("label", F.lit(" = "), T.clip(F.col("value"), 40)), 7))
    return out


def _keyed(df: DataFrame, shown: Column, src_ord: int) -> DataFrame:
    return df.select(
        "page_id", "tech", F.when(F.col("is_version"), shown).otherwise(F.col("label")).alias("text"),
        valid_version(F.when(F.col("is_version"), F.col("value"))).alias("version"), F.lit(C.RANK["dom"]).alias("rank"),
        F.lit(False).alias("likely"), F.lit(src_ord).alias("src_ord"), "pat_ord", F.lit(0).cast("long").alias("seq"),
    )


def evidence_lists(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(page_id, tech, ev): lines deduplicated by text, in order; ``limit`` keeps so many plus any with a version."""
    one = lines.groupBy("page_id", "tech", "text").agg(
        F.min_by(F.struct("src_ord", "pat_ord", "seq", "version", "rank", "likely"), F.struct("src_ord", "pat_ord", "seq")).alias("e")
    )
    item = F.struct("e.src_ord", "e.pat_ord", "e.seq", "text", "e.version", "e.rank", "e.likely")
    per = one.groupBy("page_id", "tech").agg(F.array_sort(F.collect_list(item)).alias("ev"))
    return per if limit is None else per.withColumn("ev", F.filter("ev", lambda e, i: (i < limit) | e["version"].isNotNull()))


def pick_version(ev: Column) -> Column:
    """struct(version, likely): strongest source, then most frequent, then first seen."""
    versioned = F.filter(ev, lambda e: e["version"].isNotNull())
    top = T.let(versioned, lambda x: F.filter(x, lambda e: e["rank"] == F.array_min(F.transform(x, lambda y: y["rank"]))))

    def choose(t: Column) -> Column:
        values = F.transform(t, lambda e: e["version"])
        ranked = F.transform(
            F.array_distinct(values),
            lambda v, i: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")),
        )
        version = F.array_min(ranked)["v"]
        first = F.get(F.filter(t, lambda e: e["version"] == version), F.lit(0))
        return F.when(F.size(t) > 0, F.struct(first["version"].alias("version"), first["likely"].alias("likely")))

    return T.let(top, choose)


def ordered_evidence(ev: Column, picked: Column) -> Column:
    """Evidence texts: those that gave the version first, then by strength."""
    keyed = F.transform(
        ev, lambda e, i: F.struct((~F.coalesce(e["version"] == picked["version"], F.lit(False))).alias("late"), e["rank"].alias("rank"), i.alias("i"), e["text"].alias("text"))
    )
    return F.transform(F.array_sort(keyed), lambda e: e["text"])


def with_implied(lists: DataFrame, cms_pages: DataFrame | None = None, catalog=None) -> DataFrame:
    """Add implied technologies that have no evidence of their own."""
    spark = lists.sparkSession
    order = C.tech_table(spark, catalog).select("tech", "cat_ord")
    sources = lists.select("page_id", "tech").join(F.broadcast(C.implies_table(spark, catalog)), "tech").join(F.broadcast(order), "tech")
    firsts = sources.groupBy("page_id", "implied").agg(F.min_by("by_name", "cat_ord").alias("by"))
    texts = firsts.select("page_id", F.col("implied").alias("tech"), F.concat(F.lit("implied by "), "by").alias("text"), F.lit(0).alias("prio"))
    if cms_pages is not None:
        extra = cms_pages.select("page_id", F.lit("wordpress").alias("tech"), F.lit("implied by its plugins or theme").alias("text"), F.lit(1).alias("prio"))
        texts = texts.unionByName(extra).groupBy("page_id", "tech").agg(F.min_by("text", "prio").alias("text"))
    new = texts.join(lists.select("page_id", "tech"), ["page_id", "tech"], "left_anti")
    item = F.struct(
        F.lit(99).alias("src_ord"), F.lit(0).alias("pat_ord"), F.lit(0).cast("long").alias("seq"), F.col("text"),
        F.lit(None).cast("string").alias("version"), F.lit(C.RANK["implied"]).alias("rank"), F.lit(False).alias("likely"),
    )
    return lists.withColumn("implied", F.lit(False)).unionByName(
        new.select("page_id", "tech", F.array(item).alias("ev"), F.lit(True).alias("implied"))
    )


def tech_rows(lists: DataFrame, catalog=None, details: DataFrame | None = None) -> DataFrame:
    """One row per page and technology, plugins aside."""
    meta = C.tech_table(lists.sparkSession, catalog)
    df = lists.join(F.broadcast(meta), "tech").where("`group` <> 'plugin'").withColumn("_p", pick_version(F.col("ev")))
    df = df.select(
        "page_id", "tech", "name", "group", "group_ord", "cat_ord",
        F.when(F.col("_p").isNotNull(), V.clean_version(F.col("_p.version"))).alias("version"),
        F.when(F.col("_p").isNotNull(), F.when(F.col("_p.likely"), "likely").otherwise("confirmed")).alias("confidence"),
        "implied", "npm", ordered_evidence(F.col("ev"), F.col("_p")).alias("evidence"),
    )
    if details is None:
        return df.withColumn("detail", F.lit(None).cast("string"))
    return df.join(details.withColumn("tech", F.lit("shopify")), ["page_id", "tech"], "left")


def storefront_theme(signals: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    """(page_id, detail): storefront theme name and version."""
    pattern = r"(?<![A-Za-z0-9_])Shopify\.theme\s*=\s*(\{[^;]*?\})\s*;"
    code = signals.where("kind = 'inline'").where(F.col("value").rlike(pattern))
    code = code.groupBy("page_id").agg(F.min_by("value", "seq").alias("v")).withColumn("j", F.regexp_extract("v", pattern, 1))
    found = code.select("page_id", F.get_json_object("j", "$.schema_name").alias("name"), F.get_json_object("j", "$.schema_version").alias("version"), F.lit(1).alias("prio"))
    if runtime is not None:
        key = lambda k: F.max(F.when(F.col("key") == f"shopify.theme.schema_{k}", F.col("value")))
        live = runtime.where("space = 'tech' and key like 'shopify.theme.schema%'").groupBy("page_id").agg(key("name").alias("name"), key("version").alias("version"))
        found = found.unionByName(live.withColumn("prio", F.lit(0)))
    best = found.where(F.col("name").isNotNull()).groupBy("page_id").agg(F.min_by(F.struct("name", "version"), "prio").alias("t"))
    version = F.coalesce(F.concat(F.lit(" "), T.blank_to_null(T.clip(F.col("t.version"), 20))), F.lit(""))
    return best.select("page_id", F.concat(F.lit("Theme "), T.clip(F.col("t.name"), 60), version).alias("detail"))


# ---- report rows

# Severity and label of each update status.
UPDATE_CLASS = {
    "latest": "good", "patched": "neutral", "update": "warn", "unsupported": "bad", "behind": "warn",
    "prerelease": "accent", "unlisted": "neutral", "unknown": "neutral",
}
BEHIND = ["update", "unsupported", "behind"]
LIBRARIES = ["jquery", "gsap", "alpine", "htmx"]
APP_FRAMEWORKS = ["nextjs", "nuxt", "astro", "sveltekit", "gatsby", "remix", "angular"]
CDNS = ["cloudflare", "cloudfront", "fastly", "akamai"]


def update_label(update: Column) -> Column:
    """Readable update status."""
    s = update["status"]
    return (
        F.when(s == "latest", "Latest").when(s == "patched", "Older branch, patched")
        .when(s == "update", F.concat(F.lit("Update available ("), update["branch"], F.lit(")")))
        .when(s == "unsupported", "Unsupported").when(s == "prerelease", "Prerelease").when(s == "unlisted", "Not on wordpress.org")
        .when(s.isin("behind", "unknown"), F.concat(F.lit("Latest is "), update["latest"]))
    )


def update_class(update: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in UPDATE_CLASS.items():
        out = F.when(update["status"] == k, v).otherwise(out)
    return out


def built_with(rows: DataFrame) -> DataFrame:
    """Chips per page: platforms with updates, one framework, one host."""
    if "update" not in rows.columns:
        rows = rows.withColumn("update", F.lit(None).cast("struct<status:string,latest:string,branch:string>"))
    label = F.concat("name", F.coalesce(F.concat(F.lit(" "), "version"), F.lit("")))
    chip = lambda df, ord_, key=F.col("tech"), text=label, kind=F.lit("neutral"): df.select("page_id", F.lit(ord_).alias("ord"), "cat_ord", key.alias("key"), text.alias("label"), kind.alias("kind"))
    platforms = rows.where("`group` = 'platform'")
    behind = platforms.where(F.col("update.status").isin(BEHIND))
    has_platform = platforms.select("page_id", F.lit(True).alias("_platform")).distinct()
    fw = rows.where("`group` = 'framework' and not implied").where(~F.col("tech").isin(LIBRARIES)).join(has_platform, "page_id", "left")
    prio = F.when(F.col("tech").isin(APP_FRAMEWORKS), 0).when(F.col("version").isNotNull(), 1).when(F.col("_platform").isNull(), 2)
    first = lambda df, p: df.withColumn("_prio", p).where(F.col("_prio").isNotNull()).withColumn(
        "_n", F.row_number().over(W.partitionBy("page_id").orderBy("_prio", "cat_ord"))).where("_n = 1")
    hosts = rows.where("`group` = 'hosting'")
    return (
        chip(platforms, 0)
        .unionByName(chip(behind, 1, F.concat("tech", F.lit(":update")), update_label(F.col("update")), update_class(F.col("update"))))
        .unionByName(chip(first(fw, prio), 2))
        .unionByName(chip(first(hosts, F.when(F.col("tech").isin(CDNS), 1).otherwise(0)), 3, text=F.col("name")))
    )


def tab_rows(tech: DataFrame, themes: DataFrame, plugins: DataFrame) -> DataFrame:
    """Themes, plugins and technologies in one table, by report group."""
    order = F.when(F.col("group") == "platform", 0).when(F.col("group") == "framework", 1).when(F.col("group") == "hosting", 3).otherwise(4)
    a = tech.select("page_id", F.col("group"), order.alias("group_no"), F.col("cat_ord").cast("long").alias("row_ord"), F.lit("tech").alias("kind"), "name", "version")
    b = themes.select("page_id", F.lit("wordpress").alias("group"), F.lit(2).alias("group_no"), F.col("row_no").cast("long").alias("row_ord"), F.lit("theme").alias("kind"), "name", "version")
    c = plugins.select("page_id", F.lit("wordpress").alias("group"), F.lit(2).alias("group_no"), (F.col("row_no") + 1000).cast("long").alias("row_ord"), F.lit("plugin").alias("kind"), "name", "version")
    return a.unionByName(b).unionByName(c)


def group_counts(rows: DataFrame) -> DataFrame:
    """Rows per page and report group."""
    return rows.groupBy("page_id", "group").agg(F.count("*").alias("n"))
