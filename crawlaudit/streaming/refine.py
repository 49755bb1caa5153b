"""Results refined as side data arrives (W1): change propagation over logs of every source.

A page is extracted when it arrives and never again. Its result names the keys of side tables that it looked up, found or
not: the containers it loads, its own response, the packages whose versions it compares. When rows of a side table arrive, the
keys whose newest row really changed are joined with the keys that results named, and only those pages are derived anew, from
their stored extraction and the side tables as they stand.

Each source has an append-only log that is read latest-wins, so late rows and repeated batches change nothing. Steps are
numbered in the order in which they begin; a retried batch finds its own number again and rewrites its own folders. The
newest step of a page is its result. Steps of all sources run one after the other in one driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.skew import drop_tables, lookup_join, stored
from .incremental import BatchLog, latest_wins

KEYS = "array<struct<source:string,key:string>>"
PAGES = "page_id bigint, url string, collected_at timestamp, batch int"


@dataclass
class Side:
    """A side table: its schema, the column by which pages look it up, and the column that orders its rows."""

    schema: str
    key: str
    version: str = "fetched_at"

    def types(self) -> str:
        return f"{self.schema}, {self.version} timestamp" if f"{self.version} timestamp" not in self.schema else self.schema


class Refinery:
    """Audit results of a crawl that side data refines.

    ``extract`` maps pages (page_id, url, html) to stored facts with their page_id. ``derive`` maps (pages, facts, sides) to
    (page_id, result, keys): one row for each page that has anything to say, with ``keys`` of the type ``KEYS``. ``result``
    is the type of the results column.
    """

    def __init__(self, spark: SparkSession, path: str, sides: dict[str, Side], facts: str, result: str,
                 extract: Callable[[DataFrame], DataFrame], derive: Callable[[DataFrame, DataFrame, dict[str, DataFrame]], DataFrame]):
        self.spark, self.path, self.sides, self.extract, self.derive = spark, path.rstrip("/"), sides, extract, derive
        self.facts = facts
        self.logs = {name: BatchLog(spark, f"{self.path}/{name}", side.types(), side.key, side.version) for name, side in sides.items()}
        self.pages = BatchLog(spark, f"{self.path}/pages", PAGES)
        self.results = BatchLog(spark, f"{self.path}/results", f"page_id bigint, url string, step int, result {result}, keys {KEYS}", "url", "step")

    # ---- steps

    def add_pages(self, batch: DataFrame, number: int) -> None:
        """Extracts and derives arriving pages (page_id, url, html, collected_at); an older load of an address changes nothing."""
        step = self._step("pages", number)
        batch = latest_wins(batch, "url", "collected_at")
        self.extract(batch).write.mode("overwrite").parquet(f"{self.path}/facts/batch={number}")
        self.pages.append(batch.select("page_id", "url", "collected_at", F.lit(number).alias("batch")), number)
        current = self.pages.read().where(F.col("batch") == number)
        self._derive(current, step)

    def add_side(self, name: str, batch: DataFrame, number: int) -> None:
        """Takes rows of a side table and derives the pages that looked up a key which they change."""
        step = self._step(name, number)
        log, side = self.logs[name], self.sides[name]
        changed = stored(self.changed(name, batch, number))
        log.append(batch.select(*log.columns), number)
        named = self.results.read().select("url", F.explode("keys").alias("k")).where(F.col("k.source") == name).select("url", F.col("k.key").alias("key"))
        # A key that a third of all pages look up is spread like any hot key.
        touched = lookup_join(named, changed, ["key"], "inner").select("url").distinct()
        self._derive(self.pages.read().join(touched, "url", "left_semi"), step)
        drop_tables(changed)

    def changed(self, name: str, batch: DataFrame, number: int) -> DataFrame:
        """(key) of the side table whose newest row is another one with the batch than without it."""
        log, side = self.logs[name], self.sides[name]
        rank = lambda df, new: df.select(F.col(side.key).cast("string").alias("key"), F.struct(F.col(side.version).alias("v"), F.to_json(F.struct(*[c for c in log.columns if c != side.key])).alias("j")).alias("r"), F.lit(new).alias("new"))
        came = rank(batch.select(*log.columns), True)
        had = rank(log.read(without=number), False).join(came.select("key").distinct(), "key", "left_semi")
        best = lambda new: F.max(F.when(F.col("new") == new, F.col("r")))
        both = came.unionByName(had).groupBy("key").agg(best(True).alias("came"), best(False).alias("had"))
        return both.where("had is null or came > had").select("key")

    def _derive(self, pages: DataFrame, step: int) -> None:
        pages = stored(pages.select("page_id", "url", "batch"))
        batches = [r["batch"] for r in pages.select("batch").distinct().collect()]  # folders of extracted pages to read
        facts = self.spark.read.schema(f"{self.facts}, batch int").parquet(f"{self.path}/facts").where(F.col("batch").isin(batches)) if batches else None
        if facts is None:
            found = self.spark.createDataFrame([], self.results.schema)
        else:
            mine = stored(facts.join(pages.select("page_id", "batch"), ["page_id", "batch"], "left_semi").drop("batch"))
            out = self.derive(pages.select("page_id", "url"), mine, {name: log.read() for name, log in self.logs.items()})
            # A page without anything to say replaces what it said before.
            found = pages.select("page_id", "url").join(out, "page_id", "left").select("page_id", "url", F.lit(step).alias("step"), "result", F.coalesce("keys", F.array().cast(KEYS)).alias("keys"))
        self.results.append(found, step)
        drop_tables(pages, *([mine] if facts is not None else []))

    def _step(self, source: str, number: int) -> int:
        """The number of a batch's step: its own if it was begun before, else the next."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = hadoop(f"{self.path}/steps")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        begun = [s.getPath().getName().split(".") for s in fs.listStatus(folder)] if fs.exists(folder) else []
        for step, of, batch in begun:
            if of == source and int(batch) == number:
                return int(step)
        step = max((int(s) for s, _, _ in begun), default=0) + 1
        fs.mkdirs(hadoop(f"{self.path}/steps/{step}.{source}.{number}"))
        return step

    # ---- streams and results

    def start(self, source: str, stream: DataFrame) -> StreamingQuery:
        """Feeds a stream of pages or of a side table; its checkpoint is kept beside the logs."""
        def feed(batch: DataFrame, number: int) -> None:
            batch = batch.persist()  # read by several jobs; recomputed from the stream's files where an executor is lost
            self.add_pages(batch, number) if source == "pages" else self.add_side(source, batch, number)
            batch.unpersist()

        return stream.writeStream.foreachBatch(feed).option("checkpointLocation", f"{self.path}/checkpoints/{source}").trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """(page_id, url, result): the newest result of every page."""
        return self.results.read().select("page_id", "url", "result")

    def derived(self) -> DataFrame:
        """(step, pages): how many pages each step derived."""
        return self.results.all_rows().groupBy("step").agg(F.count("*").alias("pages"))
