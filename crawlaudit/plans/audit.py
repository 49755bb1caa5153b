"""The page audit (A5, A26, A27) and the site roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import directives as D, text as T, urls as U
from ..operators import page as A
from ..operators.extract import page_records
from ..operators.robots import check_urls
from ..operators.skew import lookup_join, staged
from ..sources.tables import http_facts


_FACTS = "struct<status:int,x_robots_tag:string,final_url:string>"


def with_verdict(df: DataFrame, responses: DataFrame | None = None, robots_files: DataFrame | None = None) -> DataFrame:
    """Add indexable, reasons, unknown, allowed and status to rows with page_id, url and head (A5).

    Only the columns of ``df`` travel to the joins; page text never does.
    """
    pages = df.select("page_id", "url")
    if responses is None:
        df = df.withColumn("_http", F.lit(None).cast(_FACTS))
    else:
        df = lookup_join(df, http_facts(responses).select("url", F.struct("status", "x_robots_tag", "final_url").alias("_http")), ["url"])
    if robots_files is None:
        df = df.withColumn("allowed", F.lit(None).cast("boolean"))
    else:
        df = df.join(check_urls(pages, robots_files).select("page_id", "allowed"), "page_id", "left")
    known = F.col("allowed").isNotNull()
    verdict = A.indexability(F.col("head"), F.col("url"), F.col("_http"), F.coalesce("allowed", F.lit(True)), known)
    df = df.withColumn("_v", verdict).withColumn("status", F.col("_http.status"))
    return df.select("*", "_v.*").drop("_v", "_http")


def indexability(pages: DataFrame, responses: DataFrame | None = None, robots_files: DataFrame | None = None) -> DataFrame:
    """(page_id, indexable, reasons, unknown, allowed, status) per page (A5)."""
    df = staged(page_records(pages, "head").select("page_id", "url", "head"))
    return with_verdict(df, responses, robots_files).select("page_id", "indexable", "reasons", "unknown", "allowed", "status")


def page_audit(pages: DataFrame, responses: DataFrame | None = None, robots_files: DataFrame | None = None) -> DataFrame:
    """Everything about a page in one row.

    Page text is read once: one narrow stage extracts and counts, its result is staged,
    and the verdict joins work on that.
    """
    records = page_records(pages, "head", "word_count", "headings", "links", "images", "og", "twitter", "hreflang", "jsonld")
    linked = A.classify_links(records)
    head, url = F.col("head"), F.col("url")
    wide = linked.select(
        "page_id", "url", "head", U.bare_host(url).alias("host"), "word_count",
        head["title"].alias("title"), T.length_status(head["title"], T.TITLE_RANGE).alias("title_status"),
        head["description"].alias("description"), T.length_status(head["description"], T.DESCRIPTION_RANGE).alias("description_status"),
        A.canonical_status(head["canonicals"], url).alias("canonical_status"),
        D.directives_chip(A.meta_directives(head)).alias("robots_chip"),
        head["lang"].alias("lang"), *A.page_flags(head, url), *A.heading_counts(F.col("headings")),
        F.size(A.heading_issues(F.col("headings"))).alias("heading_issues"),
        A.link_stats(F.col("links")).alias("link_stats"), A.image_stats(F.col("images")).alias("image_stats"),
        A.missing_social(F.col("og"), F.col("twitter")).alias("missing_social"),
        F.size("hreflang").alias("alternates"), F.size("jsonld").alias("jsonld_blocks"),
    )
    return with_verdict(staged(wide), responses, robots_files).drop("head")


def site_rollup(pages: DataFrame) -> DataFrame:
    """Per host: pages, title lengths, H1 issues, words and link counts, combined before the shuffle."""
    records = A.classify_links(page_records(pages, "head", "word_count", "headings", "links"))
    stats = A.link_stats(F.col("links"))
    per_page = records.select(
        U.bare_host(F.col("url")).alias("host"), "word_count", T.length_status(F.col("head.title"), T.TITLE_RANGE).alias("title"),
        F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1"), stats.alias("s"),
    )
    return per_page.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("title") == "good").alias("good_titles"),
        F.count_if(F.col("h1") != 1).alias("h1_issues"), F.sum("word_count").alias("words"),
        F.sum("s.total").alias("links"), F.sum("s.internal").alias("internal_links"), F.sum("s.external").alias("external_links"),
    )
