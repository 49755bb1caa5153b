"""Exact duplicates (operator 6) by an extendible-hash index on shared files.

1. Every text is normalised and hashed to 64 bits; an aggregate counts the rows of each hash.
2. The directory starts with one bucket. While a bucket holds more than ``BUCKET_KEYS`` hashes, the directory doubles: the
   overfull buckets split by the next bit of the hash, the others keep their depth. All depths up to ``DEPTH`` are counted
   in one aggregate, so the directory has at most 2 ** ``DEPTH`` entries, whatever the corpus, and can be broadcast.
3. The index is written to shared files: every row with its bucket and hash, and with its text where other rows have the
   same hash. A bucket is a range of hashes, and the tasks that own it compare what collides in it.
4. Collisions are chained. The first row of a hash is compared byte by byte with the others; those that differ form the
   next link of the chain, until none are left. One link is enough unless two texts share a hash.

Nothing but DataFrame operations runs. A hash that a third of all rows share stays balanced: counts and minima are
combined before the shuffle, and rows meet their chain's head in plain equi joins of stored tables, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANK, stage

BUCKET_KEYS = 100_000
DEPTH = 16
# A row's place in the order of its group: smallest doc_id first, null last, repeated rows by their number.
ORDER = ("absent", "doc_id", "row")


def normalised(text: Column) -> Column:
    """Null as the empty text; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, depth: int = DEPTH) -> DataFrame:
    """(entry, bucket, local_depth) for each entry of the hashes ``h`` that is in use.

    An entry is the hash's first ``depth`` bits. Its bucket has the smallest local depth at which no more than
    ``bucket_keys`` hashes share the bucket's bits, and is named by its first entry.
    """
    entries = stage(keys.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("entry")).agg(F.count("*").alias("n")), "entries")
    levels = entries.select("entry", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
    first = F.expr(f"shiftleft(shiftright(entry, {depth} - local_depth), {depth} - local_depth)")
    levels = levels.withColumn("bucket", first)
    fit = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= bucket_keys) | (F.col("local_depth") == depth))
    split = levels.join(fit, ["local_depth", "bucket"]).groupBy("entry").agg(F.min(F.struct("local_depth", "bucket")).alias("b"))
    return stage(split.select("entry", "b.bucket", "b.local_depth"), "directory")


def find_copies(docs: DataFrame, key: Column | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Every row of ``docs`` with all its columns in ``d``, and its group: keep_id, group_size, kept, text_sha256, bucket.

    Of rows with equal normalised texts the one with the smallest doc_id stays; a null doc_id comes last, and of rows
    that repeat a doc_id one stays. ``key`` is the 64-bit hash of the column ``norm``, xxhash64 by default. An empty
    table gives no rows.
    """
    key = F.xxhash64("norm") if key is None else key
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).withColumn("norm", normalised(F.col("d.text"))).withColumn("h", key)
    hashes = stage(rows.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    shared = hashes.where("n > 1").select(F.col("h").alias("chained"))
    # Texts meet in a shuffle at every size: what they meet here grows with the corpus and is not for broadcasting.
    index = rows.join(shared.hint("merge"), rows["h"] == shared["chained"], "left")
    index = index.join(F.broadcast(directory(hashes, bucket_keys)), F.shiftrightunsigned("h", 64 - DEPTH) == F.col("entry"))
    return index.select(
        "d", "h", "bucket", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.when(F.col("chained").isNotNull(), F.col("norm")).alias("bytes"),
        F.col("d.doc_id").isNull().alias("absent"), F.col("d.doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
    )


def resolve(index: DataFrame) -> DataFrame:
    """Rows of a stored index with the head of their group: head_id, head_row, and the group's size."""
    narrow = [c for c in index.columns if c not in ("bytes", "absent")]
    alone = index.where("bytes is null").select(*narrow, F.col("doc_id").alias("head_id"), F.col("row").alias("head_row"), F.lit(1).cast("long").alias("group_size"))
    open_, done = index.where("bytes is not null"), []
    while True:
        heads = open_.groupBy("h").agg(F.min_by(F.struct("doc_id", "row", "bytes"), F.struct(*ORDER)).alias("head"))
        heads = stage(heads.select(F.col("h").alias("of"), F.col("head.doc_id").alias("head_id"), F.col("head.row").alias("head_row"), F.col("head.bytes").alias("head_bytes")), "heads")
        met = open_.join(heads.hint("merge"), open_["h"] == heads["of"]).withColumn("same", F.col("bytes") == F.col("head_bytes"))
        met = stage(met.select(*narrow, "absent", F.when(~F.col("same"), F.col("bytes")).alias("bytes"), "same", "head_id", "head_row"), "met")
        sizes = stage(met.where("same").groupBy(F.col("head_row").alias("group_of")).agg(F.count("*").alias("group_size")), "sizes")
        same = met.where("same")
        done.append(same.join(sizes, same["head_row"] == sizes["group_of"]).select(*alone.columns))
        open_ = met.where("not same").select(*index.columns)
        if open_.isEmpty():
            break
    for part in done:
        alone = alone.unionByName(part)
    return alone


def exact_duplicates(docs: DataFrame, key: Column | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket), one row for each row of ``docs``."""
    index = stage(find_copies(docs.select("doc_id", "text"), key, bucket_keys).drop("d"), "index")
    return resolve(index).select("doc_id", F.col("head_id").alias("keep_id"), "group_size", (F.col("row") == F.col("head_row")).alias("kept"), "text_sha256", "bucket")


def without_copies(docs: DataFrame, key: Column | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    index = stage(find_copies(docs, key, bucket_keys), "index")
    return resolve(index).where(F.col("row") == F.col("head_row")).select("d.*")
