"""Schemas of the input tables and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Explicit schemas; nothing is inferred.
SCHEMAS = {
    "pages": "page_id bigint, url string, html string",
    "responses": "url string, status int, redirected boolean, final_url string, headers map<string,string>, body string, error string",
    "robots_files": "origin string, status int, body string, error string",
    "page_requests": "page_id bigint, seq int, url string",
    "runtime_state": "page_id bigint, space string, key string, value string",
    "render_boxes": "page_id bigint, idx int, tag string, width int, height int, shown_width int, shown_height int, shown boolean",
    "image_sizes": "url string, width int, height int, failed boolean",
    "containers": "container_id string, url string, text string, error string",
    "probes": "page_id bigint, kind string, slug string, url string, text string, capped boolean, error string",
    "latest": "key string, kind string, name string, version string, offers array<string>, unlisted boolean, theme_name string, error string, fetched_at timestamp",
    "url_index": "bare_url string",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a parquet input table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Crawled pages (S1). ``partitions`` deals them out anew, for small files that read as one split."""
    pages = read_table(spark, path, "pages")
    return pages if partitions is None else pages.repartition(partitions, "page_id")


def newest(df: DataFrame, key: str, version: str = "fetched_at") -> DataFrame:
    """One row per key: the newest by ``version`` where the table has it, ties by the row's own content.

    An aggregate, so only the winner of each partial group is shuffled.
    """
    cols = [c for c in df.columns if c != key]
    rank = [F.col(version)] if version in cols else []
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*rank, F.to_json(F.struct(*cols)))).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in cols]).select(*df.columns)


def http_facts(responses: DataFrame) -> DataFrame:
    """Response columns the audit needs, one row per URL (S7); failed requests are left out, so they stay unknown."""
    name = lambda n: F.get(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    return newest(responses.where("error is null"), "url").select(
        "url", "status", "redirected", "final_url", name("x-robots-tag").alias("x_robots_tag"),
        name("content-type").alias("content_type"), name("link").alias("link"),
    )


def latest_snapshot(pages: DataFrame) -> DataFrame:
    """Newest snapshot per URL by ``collected_at``, ties by page_id.

    Aggregated rather than windowed: only the winning row of each partial group is shuffled.
    """
    cols = [c for c in pages.columns if c != "url"]
    best = pages.groupBy("url").agg(F.max_by(F.struct(*cols), F.struct("collected_at", "page_id")).alias("p"))
    return best.select("url", *[F.col(f"p.{c}").alias(c) for c in cols])


def runtime_values(runtime: DataFrame, space: str) -> DataFrame:
    """Runtime rows of one space: tracker, ran or tech (S5, S6). Missing is not false."""
    return runtime.where(F.col("space") == space).select("page_id", "key", "value")
