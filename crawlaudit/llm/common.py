"""What the operators share: table reading, tables in the shared folder, components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# The white space of every contract, space and \x09-\x0D.
BLANK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

_local: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    A folder of this machine stands in only where the setting is missing and the master is
    local, as in tests; elsewhere its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local.setdefault("dir", "") or tempfile.mkdtemp(prefix="spark-")
        _local["dir"] = folder
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in storage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # What the table was made from is not needed again; its shuffle files go once the driver has noticed.
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Remove tables of :func:`stage` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Labels start at the smallest neighbour; a round takes the smallest label among the
    neighbours and then the label of that label, so paths shrink by half. Each round is an
    aggregate combined before its shuffle and joins whose hot side adaptive execution can
    split; it ends in a staged table, and the driver sees one number per round.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        near = stage(labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "near")
        up = near.select(F.col("node").alias("at"), F.col("root").alias("above"))
        after = stage(near.join(up, near["root"] == up["at"], "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "labels")
        changed = after.where("root <> old").count()
        drop_staged(labels, near)
        labels = after.select("node", "root")
        if not changed:
            drop_staged(both)
            return labels
    raise RuntimeError(f"components: no fixpoint in {max_rounds} rounds")
