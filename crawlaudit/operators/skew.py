"""Joins that stay balanced when one key, or none, holds a third of the rows, and stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A key is hot from this share of all left rows on, so at most 1 / HOT_SHARE keys are; their rows go to SALTS buckets.
HOT_SHARE = 1 / 256
SALTS = 64


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hot_share: float = HOT_SHARE,
                salts: int = SALTS) -> DataFrame:
    """Join a fact side to a side that is unique per key, hot and NULL keys salted.

    Key counts come from a map-side-combined aggregate over the key columns alone. The list of hot keys is bounded by
    its definition, whatever the rows, and is broadcast. The right row of a hot key is repeated once per salt; every
    other row once. A NULL key meets nothing, so its rows are only spread.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all")).scalar()
    hot = counts.where(F.col("_n") >= total * F.lit(hot_share)).where(" and ".join(f"{k} is not null" for k in keys))
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    row_hash = F.pmod(F.xxhash64(*left.columns), F.lit(salts)) if _hashable(left) else F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    spread = F.when(F.col("_hot") | F.expr(" or ".join(f"{k} is null" for k in keys)), row_hash).otherwise(F.lit(0)).cast("int")
    all_salts = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
    l = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_hot")
    r = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> bool:
    return not any(f.dataType.simpleString().find("map<") >= 0 for f in df.schema.fields)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.setdefault("folder", None) or tempfile.mkdtemp(prefix="spark-")
        _LOCAL["folder"] = folder
    return folder.rstrip("/")


_LOCAL: dict = {}
_STAGED: list[str] = []
_TABLES: list[str] = []


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write an intermediate table several stages read, and read it back.

    Cuts lineage in storage that outlives executors, and gives later readers column
    pruning, filters and sizes. ``drop_staged`` removes the tables when their query is done.
    """
    path = f"{shared_folder(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    _STAGED.append(path)
    return _written(df, path, *partition_by)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """A stored table whose maker removes it with ``drop_tables``."""
    return _written(df, f"{shared_folder(df.sparkSession)}/staged/{uuid.uuid4().hex}", *partition_by)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """An intermediate table in buckets of ``key``, of as many as there are shuffle partitions.

    It costs one exchange. Aggregates, windows and joins whose keys hold ``key`` then run inside a bucket, as often as
    they like: their plans need none.
    """
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/staged/{name}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    _STAGED.append(path)
    _TABLES.append(name)
    return spark.table(name)


def _written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.split("/staged/")[0] + "/staged/" + f.split("/staged/")[1].split("/")[0] for f in table.inputFiles()}:
            _remove(spark, folder)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove every table staged so far; what reads them must have ended."""
    for path in _STAGED:
        _remove(spark, path)
    for name in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _STAGED.clear()
    _TABLES.clear()
