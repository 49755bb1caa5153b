"""Approximate nearest neighbours (operator 10): a forest of random-projection trees.

The trees are fitted on a bounded sample: a node splits its sample at the median of a projection on the difference of two
random vectors. The forest has ``TREES`` trees of at most ``LEAVES`` leaves, so it is small, whatever the table, and goes to
every task; all rows are indexed by the leaves that they fall into.

A query's search has one priority queue for all trees. It holds branches not taken, by how far the query is from the
splitting planes between (their squares summed); the nearest is followed to its leaf, until the leaves hold ``VISIT`` times the rows there are, a row counted
once for each tree it is met in. The rows of those leaves are the candidates, and they are reranked by exact cosine in double
precision.

Vectors of different lengths have no cosine, so each length has a forest of its own; a length too rare for the sample has one
leaf, which its queries search whole.

Spark brings the rows of a leaf and the queries that visit it together. A leaf of many rows, such as one with a vector
that a third of all rows share, is cut into parts of bounded size, each visited on its own; a part gives its five best
to each query, so what leaves it does not grow with its rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

TREES = 4
LEAVES = 64
SAMPLE_ROWS = 20_000
VISIT = 1.2
TOP = 5
PART_ROWS = 8192
SEED = 11


class Tree:
    """One random-projection tree as arrays; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, rng: np.random.Generator):
        self.normal: list[np.ndarray] = []
        self.cut: list[float] = []
        self.kids: list[list[int]] = []  # a child >= 0 is a node, else leaf -1 - child
        self.leaves = 0
        self.root = self._grow(sample, leaves, rng)

    def _grow(self, rows: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves > 1 and len(rows) > 1:
            a, b = rows[rng.choice(len(rows), 2, replace=False)]
            if (length := np.linalg.norm(a - b)) > 0:
                normal = (a - b) / length
                at = rows @ normal
                cut = float(np.median(at))
                low = at <= cut
                if low.any() and not low.all():
                    node = len(self.cut)
                    self.normal.append(normal), self.cut.append(cut), self.kids.append([0, 0])
                    self.kids[node] = [self._grow(rows[low], leaves // 2, rng), self._grow(rows[~low], leaves // 2, rng)]
                    return node
        self.leaves += 1
        return -self.leaves

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.full(len(rows), self.root)
        while (inner := np.nonzero(at >= 0)[0]).size:
            for node in np.unique(at[inner]):
                here = inner[at[inner] == node]
                right = rows[here] @ self.normal[node] > self.cut[node]
                at[here] = np.where(right, self.kids[node][1], self.kids[node][0])
        return -1 - at


def plant(sample: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree(sample, leaves, rng) for _ in range(trees)]


def visits(forest: list[Tree], query: np.ndarray, held: dict[tuple[int, int], int], limit: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until they hold ``limit`` rows."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out, rows = [], 0
    while queue and rows < limit:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            side = float(query @ tree.normal[node]) - tree.cut[node]
            near, other = tree.kids[node][side > 0], tree.kids[node][side <= 0]
            heapq.heappush(queue, (far + side * side, t, other))
            node = near
        if n := held.get((t, -1 - node), 0):
            out.append((t, -1 - node))
            rows += n
    return out


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): vectors that take part. Null, zero, or with a part that is null or not finite: left out."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small parts neither overflow nor vanish.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest part to about one: exact, and nothing overflows or vanishes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(-1, keepdims=True))[1])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query; equal rows give equal values wherever they stand."""
    rows, query = _scaled(rows), _scaled(query)
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def best_in_part(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int) -> pd.DataFrame:
    """The ``top`` nearest rows to each query, itself left out, ties to the smaller id."""
    out = []
    units, asked = _unit(rows), _unit(queries)
    for start in range(0, len(queries), 256):
        rough = asked[start : start + 256] @ units.T
        for q, line in enumerate(rough, start):
            line[ids == query_ids[q]] = -np.inf
            # The product only chooses; whatever could be among the best is computed anew.
            bar = np.partition(line, -top)[-top] if len(line) > top else -2.0
            near = np.nonzero(line >= max(bar - 1e-9, -1.5))[0]
            score = cosines(rows[near], queries[q])
            first = np.lexsort((ids[near], -score))[:top]
            out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[near][first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, top: int = TOP, trees: int = TREES, leaves: int = LEAVES,
            visit: float = VISIT, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each query, nearest first, ties to the smaller id.

    Rows whose vector is null, zero, or holds a part that is null or not finite take no part; neither do rows with a null
    id. Candidates of a query are the vectors of its own length. Rows that repeat an id and vector count once. With ``visit``
    of ``trees`` or more every row is a candidate. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_, vector).distinct(), "vectors")
    asks = usable(queries, id_, vector).distinct()
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    forests = {n: plant(_unit(np.array(of, np.float64)), trees, leaves) for n, of in sorted(sample.items())}
    known = F.size("v").isin(sorted(forests))

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        sizes = batch.column(1).value_lengths().to_numpy()
        for n in np.unique(sizes).tolist():
            yield n, batch if (sizes == n).all() else batch.take(pa.array(np.flatnonzero(sizes == n)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n, batch in by_length(whole):
                unit = _unit(_matrix(batch.column(1)))
                fixed = pa.array(np.full(batch.num_rows, n, np.int32))
                for t, tree in enumerate(forests[n]):
                    yield pa.RecordBatch.from_arrays([fixed, pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(tree.place(unit).astype(np.int32)), batch.column(0), batch.column(1)], names=["size", "tree", "leaf", "id", "v"])

    keys = ["size", "tree", "leaf", "part"]
    placed = stage(rows.where(known).mapInArrow(place, "size int, tree int, leaf int, id long, v array<double>"), "placed")
    counted = placed.groupBy(*keys[:3]).agg(F.count("*").alias("n")).collect()  # at most trees * leaves rows for each length of the sample
    held: dict[int, dict] = {n: {} for n in forests}
    for r in counted:
        held[r["size"]][r["tree"], r["leaf"]] = r["n"]
    # A row is met once in each tree at most, so no search ends with fewer than ``top`` others to rank.
    limits = {n: max(visit * sum(of.values()) / trees, trees * (top + 1)) for n, of in held.items()}
    parts_of = lambda n: -(-n // part_rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n, batch in by_length(whole):
                found = [visits(forests[n], q, held[n], limits[n]) for q in _unit(_matrix(batch.column(1)))]
                deal = [(n, t, leaf, p, i) for i, of in enumerate(found) for t, leaf in of for p in range(parts_of(held[n][t, leaf]))]
                for a in range(0, len(deal), 20_000):
                    *key, i = (np.array(x, np.int32) for x in zip(*deal[a : a + 20_000]))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, key), *(batch.column(c).take(pa.array(i)) for c in (0, 1))], names=[*keys, "id", "v"])

    counts = spark.createDataFrame([(r["size"], r["tree"], r["leaf"], parts_of(r["n"])) for r in counted], "size int, tree int, leaf int, parts int")
    split = placed.join(F.broadcast(counts), keys[:3]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).select(*keys, "id", "v")
    asked = asks.where(known).mapInArrow(ask, "size int, tree int, leaf int, part int, id long, v array<double>")
    rare = rows.where(~known)
    if not rare.isEmpty():
        one = lambda df, part: df.select(F.size("v").alias("size"), F.lit(0).alias("tree"), F.lit(0).alias("leaf"), part.cast("int").alias("part"), "id", "v")
        sizes = rare.groupBy(F.size("v").alias("of")).agg(F.ceil(F.count("*") / part_rows).alias("parts"))
        rare = rare.join(sizes, F.size("v") == F.col("of"))
        split = split.union(one(rare, F.pmod(F.xxhash64("id", "v"), F.col("parts"))))
        asked = asked.union(one(asks.where(~known).join(sizes, F.size("v") == F.col("of")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))), F.col("p")))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        best = empty
        if left.num_rows and right.num_rows:
            best = best_in_part(left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"]), top)
        return pa.Table.from_pandas(best, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), preserve_index=False)

    found = split.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    # A row may be found in several trees, with the same score.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest_of_every(vectors: DataFrame, every: int = 50) -> DataFrame:
    """:func:`nearest` of an embeddings table, for the rows whose vec_id is divisible by ``every``."""
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), "vec_id", "embedding")
