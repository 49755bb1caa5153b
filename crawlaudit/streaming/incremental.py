"""Incremental audits with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latest import TTL_HOURS
from ..sources.tables import SCHEMAS, newest


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of arriving page files."""
    schema = SCHEMAS["pages"] + ", collected_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_wins(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key; an older row never replaces a newer one.

    A page that comes late, or twice, changes nothing but its own row; ties go by the row's content. An aggregate
    keeps only the winner of each partial group in the shuffle.
    """
    return newest(rows, key, version)


class BatchLog:
    """Audit results kept as one parquet folder per batch, read latest-wins.

    A batch writes its own rows and nothing else, so its cost follows what arrived. A
    retried batch rewrites its folder: a lost executor or a restart changes nothing.
    ``compact`` folds finished batches into one when reading them grows slow.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url", version: str = "collected_at"):
        self.spark, self.path, self.schema, self.key, self.version = spark, path.rstrip("/"), schema, key, version

    def _finished(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        numbers = [int(n[2:]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if fs.exists(path(f"{self.path}/{kind}={n}/_SUCCESS")))

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/b={batch}")

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def all_rows(self, without: int | None = None) -> DataFrame:
        """Every row of the last compaction and of every batch after it, but those of the batch ``without``."""
        bases = self._finished("c")[-1:]
        later = [b for b in self._finished("b") if (not bases or b > bases[0]) and b != without]
        folders = [f"{self.path}/c={c}" for c in bases] + [f"{self.path}/b={b}" for b in later]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, without: int | None = None) -> DataFrame:
        """Newest row per key of :meth:`all_rows`."""
        return latest_wins(self.all_rows(without), self.key, self.version)

    def compact(self) -> None:
        """Fold every finished batch and remove the folded folders; nothing may be reading them."""
        done = self._finished("b")
        if done:
            self.read().write.mode("overwrite").parquet(f"{self.path}/c={done[-1]}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for folder in [f"b={b}" for b in done] + [f"c={c}" for c in self._finished("c")[:-1]]:
                fs.delete(path(f"{self.path}/{folder}"), True)


def run_incremental(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], log: BatchLog, checkpoint: str) -> StreamingQuery:
    """Audit each batch of pages once and log the results.

    ``audit`` maps pages to rows of the log's schema; multi-join stages belong in it,
    since a batch is an ordinary DataFrame.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        log.append(audit(batch), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Answer cache after a batch: errors are not kept, the newest answer wins."""
    return latest_wins(cache.unionByName(answers.where("error is null").select(*cache.columns)), "key", "fetched_at")


CACHE_EVENTS = "key string, event string, version string, fetched_at timestamp, expires_at timestamp"


def cached_answers(answers: DataFrame, ttl_hours: int = TTL_HOURS, lateness: str = "0 seconds") -> DataFrame:
    """Stream of cache events (key, event, version, fetched_at, expires_at) from a stream of answers.

    The state of a key is its newest usable answer. It lives in Spark's checkpointed state and ends when the watermark of
    ``fetched_at`` passes the answer's life, so an answer expires although nothing of its key arrives. ``event`` is ``kept``
    for a first or newer answer and ``expired``; errors and older answers change nothing.
    """
    import pandas as pd

    life = pd.Timedelta(hours=ttl_hours)

    def follow(key, frames, state):
        if state.hasTimedOut:
            version, fetched = state.get
            state.remove()
            at = pd.Timestamp(fetched, unit="us")
            yield pd.DataFrame({"key": [key[0]], "event": ["expired"], "version": pd.array([version], "string"), "fetched_at": [at], "expires_at": [at + life]})
            return
        held = state.get if state.exists else None
        best = held
        for frame in frames:
            for version, fetched in zip(frame["version"], frame["fetched_us"]):
                if best is None or (int(fetched), version or "") > (best[1], best[0] or ""):
                    best = (version if isinstance(version, str) else None, int(fetched))
        ends = best[1] // 1000 + ttl_hours * 3_600_000
        if best != held and ends > state.getCurrentWatermarkMs():
            state.update(best)
            at = pd.Timestamp(best[1], unit="us")
            yield pd.DataFrame({"key": [key[0]], "event": ["kept"], "version": pd.array([best[0]], "string"), "fetched_at": [at], "expires_at": [at + life]})
        if state.exists:
            # A timeout fires once the watermark is beyond it: an answer's last moment is one before its end.
            state.setTimeoutTimestamp(max(state.get[1] // 1000 + ttl_hours * 3_600_000 - 1, state.getCurrentWatermarkMs() + 1))

    usable = answers.where("error is null").withWatermark("fetched_at", lateness)
    rows = usable.select("key", "version", F.unix_micros("fetched_at").alias("fetched_us"), "fetched_at")
    return rows.groupBy("key").applyInPandasWithState(follow, CACHE_EVENTS, "version string, fetched_us long", "append", "EventTimeTimeout")


def cache_state(events: DataFrame) -> DataFrame:
    """(key, version, fetched_at): what the cache holds after its logged events."""
    order = F.struct("fetched_at", F.when(F.col("event") == "expired", 1).otherwise(0).alias("late"), "version")
    last = events.groupBy("key").agg(F.max_by(F.struct("event", "version", "fetched_at"), order).alias("e"))
    return last.where("e.event = 'kept'").select("key", "e.version", "e.fetched_at")
