"""Hreflang entries, reciprocity and report (H1-H4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import directives as D, text as T, urls as U
from .extract import page_records
from .page import hreflang_issues
from ..sources.tables import newest
from .skew import lookup_join


def page_alternates(records: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Per page: array of alternates from tags and from its Link header (H1).

    ``records`` needs url and hreflang. Order is tags first, then header entries.
    """
    html = F.transform(
        "hreflang",
        lambda e: F.struct(e["lang"].alias("lang"), e["href"].alias("href"), e["raw"].alias("raw"), F.lit("html").alias("source")),
    )
    df = records.select("page_id", "url", U.strip_hash(F.col("url")).alias("page_key"), html.alias("_html"))
    if responses is None:
        return df.withColumnRenamed("_html", "entries")
    links = newest(responses.where("error is null").select("url", "headers"), "url").select(F.col("url"), D.parse_link_header(header(F.col("headers"), "link")).alias("_links"))
    base = F.col("_page")
    head = F.transform(
        F.filter(F.col("_links"), lambda l: F.coalesce(l["hreflang"], F.lit("")) != ""),
        lambda l: F.struct(
            l["hreflang"].alias("lang"), U.resolve(l["url"], base).alias("href"), l["url"].alias("raw"), F.lit("header").alias("source")
        ),
    )
    none = F.array().cast("array<struct<lang:string,href:string,raw:string,source:string>>")
    joined = df.join(links, "url", "left").withColumn("_page", U.base_parts(F.col("page_key")))
    return joined.select("page_id", "url", "page_key", F.concat("_html", F.coalesce(head, none)).alias("entries"))


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(found, F.lit(0))["value"]


def hreflang_entries(alternates: DataFrame) -> DataFrame:
    """(page_id, url, page_key, idx, lang, href, raw, source), one row per alternate."""
    df = alternates.select("page_id", "url", "page_key", F.posexplode_outer("entries").alias("idx", "e")).where(F.col("e").isNotNull())
    return df.select("page_id", "url", "page_key", "idx", "e.lang", "e.href", "e.raw", "e.source")


def fetched_records(responses: DataFrame, records: DataFrame) -> DataFrame:
    """Records of answered pages outside the crawl, read from ``responses.body`` (H2)."""
    final = F.coalesce(T.blank_to_null(F.col("final_url")), F.col("url"))
    bodies = newest(responses.where("body is not null and error is null").select(final.alias("url"), F.col("body").alias("html")), "url")
    crawled = records.select("url").distinct()
    bodies = bodies.join(crawled, "url", "left_anti")
    return page_records(bodies.select(F.lit(None).cast("bigint").alias("page_id"), "url", "html"), "head", "hreflang")


def check_alternates(entries: DataFrame, responses: DataFrame, target_records: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Status, redirect, final URL, return link and canonical of every alternate (H2).

    The return link is one equi join on the pair (target page, this page), unique
    by construction, so a page everybody points to does not pile up. It is NULL when
    the answer is not HTML and names no alternates in its header, and when nobody has
    read the target: neither the crawl nor ``responses.body``.
    """
    r = newest(responses, "url").select(
        F.col("url").alias("href_key"), "status", "redirected", F.col("final_url"), "error",
        header(F.col("headers"), "content-type").alias("content_type"),
        D.parse_link_header(header(F.col("headers"), "link")).alias("_links"),
    )
    none = F.array().cast("array<struct<url:string,rel:string,hreflang:string>>")
    has_header = F.exists(F.coalesce("_links", none), lambda l: F.coalesce(l["hreflang"], F.lit("")) != "")
    target = U.strip_hash(F.coalesce(T.blank_to_null(F.col("final_url")), F.col("href_key")))
    r = r.select("href_key", "status", "redirected", "final_url", "error", "content_type", has_header.alias("_has_header"), target.alias("_target"))
    canon = target_records.select(
        U.strip_hash(F.col("url")).alias("_target"), F.get(F.col("head.canonicals"), F.lit(0))["href"].alias("target_canonical")
    ).groupBy("_target").agg(F.min("target_canonical").alias("target_canonical")).withColumn("_parsed", F.lit(True))
    r = lookup_join(r, canon, ["_target"])
    own = entries.withColumn("href_key", U.strip_hash_text(F.col("href")))
    df = lookup_join(own, r, ["href_key"])
    df = df.withColumns({"_target": F.coalesce("_target", "href_key"), "_self": F.col("page_key")})
    # Pairs (page that links, page linked to) of the whole crawl, and whether a header says so.
    pairs = (entries if others is None else entries.unionByName(others)).select(
        F.col("page_key").alias("_target"), U.strip_hash_text(F.col("href")).alias("_self"), (F.col("source") == "header").alias("_h")
    ).groupBy("_target", "_self").agg(F.bool_or("_h").alias("_back_header"))
    df = df.join(pairs.withColumn("_back", F.lit(True)), ["_target", "_self"], "left")
    readable = F.col("status").between(200, 299) & F.coalesce(F.col("content_type"), F.lit("")).rlike("(?i)html")
    # An answer that is not HTML links back through its header alone.
    back = F.when(readable & (F.col("_back").isNotNull() | F.col("_parsed")), F.coalesce("_back", F.lit(False))).when(~readable & F.col("_has_header"), F.coalesce("_back_header", F.lit(False)))
    return df.select(
        "page_id", "url", "page_key", "idx", "lang", "href", "raw", "source", "status", "redirected", "final_url", "error",
        F.when(F.col("status").isNotNull(), back).alias("return_link"),
        F.when(readable, F.col("target_canonical")).alias("target_canonical"),
    )


def checked_alternates(records: DataFrame, responses: DataFrame) -> DataFrame:
    """Every alternate of the crawl with its check; targets outside the crawl are read from their answers (H2)."""
    fetched = fetched_records(responses, records)
    others = hreflang_entries(page_alternates(fetched, responses))
    known = records.select("url", "head").unionByName(fetched.select("url", "head"))
    return check_alternates(hreflang_entries(page_alternates(records, responses)), responses, known, others)


def status_label(df: DataFrame) -> DataFrame:
    """Add status_label, status_class and link_label to checked alternates (H3)."""
    status = F.col("status").cast("string")
    failed = F.col("error").isNotNull()
    own = U.strip_hash_text(F.col("href")) == F.col("page_key")
    return df.withColumns({
        "status_label": F.when(failed, "Failed").when(F.col("redirected"), F.concat(F.lit("3xx → "), status)).otherwise(status),
        "status_class": F.when(failed, "bad").when(F.col("redirected"), "warn").otherwise(T.status_class(F.col("status"))),
        "link_label": F.when(failed, None).when(own, "This page").when(F.col("return_link"), "Links back")
        .when(~F.col("return_link"), "No return link"),
    })


def hreflang_report(records: DataFrame, responses: DataFrame) -> DataFrame:
    """Every alternate with its check, label and the issues of its page's set (H4)."""
    alternates = page_alternates(records, responses)
    checked = status_label(checked_alternates(records, responses))
    issues = alternates.select("page_id", hreflang_issues(F.col("entries"), F.col("url")).alias("issues"))
    return checked.join(issues, "page_id", "left")
