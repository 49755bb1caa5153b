"""SimHash near-duplicates (operator 3): BK-trees over shards of fingerprints.

A document's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it set. Two fingerprints
link when at most ``RADIUS`` bits differ; components of links are the near-duplicate groups.

Equal fingerprints are one node. Fingerprints are cut into ``BLOCKS`` blocks of bits; differing in at most three bits, two
of them agree on all the rest of the blocks, so they meet in the shard of that choice of blocks. A shard is a BK-tree: a
node's children are keyed by their integer Hamming distance to it, and a search within r follows from a node at distance d
only the edges d - r to d + r. Shards grow with the corpus, so their trees are not broadcast: the shuffle brings a shard's
fingerprints together, and a shard of more than ``SHARD_ROWS`` is split into trees of bounded size which every
fingerprint of the shard visits. All the trees of a task are built and searched level by level in arrays.

A tree gives each fingerprint one link to its group in that tree instead of all pairs, so copies stay linear.

Three bits are few: texts that share four fifths of their shingles often differ by ten. To keep one document of each group,
:func:`one_of_each` also links texts whose five-word shingles have a Jaccard similarity of ``SIMILAR`` or more. Their shards
are the smallest shingle under each of ``ORDERS`` hash orders; a shard's tree is searched within ``WIDE_RADIUS`` bits, and the
sets of shingle hashes decide. Only texts that share a shard with another text are read for their sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, stage

RADIUS = 3
BLOCKS = 5
SHINGLE = 3
SHARD_ROWS = 4096
TASK_ROWS = 200_000
VISITS = 100_000

WIDE_SHINGLE = 5
SIMILAR = 0.8
ORDERS = 6
WIDE_RADIUS = 24
WIDE_SHARD_ROWS = 1024
TASK_BYTES = 32 << 20
# Shingles compared at a time.
TESTED = 1_000_000

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: bytes | None, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter, of nothing without words."""
    folded = b" ".join((text or b"").translate(_FOLD).split())
    if not folded:
        return np.zeros(0, np.uint64)
    cuts = np.nonzero(np.frombuffer(folded, np.uint8) == 32)[0].tolist()
    starts, ends = [0, *(c + 1 for c in cuts)], [*cuts, len(folded)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(folded[a:b], 42) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * total > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """Fingerprint of one text; zero without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            seen: dict = {}
            out = [seen[t] if t in seen else seen.setdefault(t, fingerprint(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


class Forest:
    """One BK-tree for each value of ``tree`` over the fingerprints ``fp``.

    Level by level: the first fingerprint of every open set becomes a node, and the others are dealt to its children by
    their distance to it. The children of a node lie side by side, sorted by distance.
    """

    def __init__(self, tree: np.ndarray, fp: np.ndarray):
        self.fp = fp
        self.children = np.zeros((len(fp), 2), np.int64)  # from, to in kid_*
        kid_node, kid_key, made = [], [], 0
        order = np.argsort(tree, kind="stable")
        first = np.concatenate([[True], tree[order][1:] != tree[order][:-1]]) if len(order) else np.zeros(0, bool)
        self.tree, self.root = tree[order][first], order[first]
        while len(order):
            # order: the fingerprints of the open sets, set by set; first marks where each begins.
            group = np.cumsum(first) - 1
            parent = order[first][group]
            distance = np.bitwise_count(fp[order] ^ fp[parent]).astype(np.int64)
            rest = ~first
            order, group, distance, parent = order[rest], group[rest], distance[rest], parent[rest]
            deal = np.lexsort((distance, group))
            order, group, distance, parent = order[deal], group[deal], distance[deal], parent[deal]
            first = np.ones(len(order), bool)
            first[1:] = (group[1:] != group[:-1]) | (distance[1:] != distance[:-1])
            heads = np.nonzero(first)[0]
            if len(heads):
                owner = parent[heads]
                new = np.concatenate([[True], owner[1:] != owner[:-1]])
                at = np.nonzero(new)[0]
                self.children[owner[at], 0] = made + at
                self.children[owner[at], 1] = made + np.concatenate([at[1:], [len(heads)]])
                kid_node.append(order[heads])
                kid_key.append(distance[heads])
                made += len(heads)
        self.kid_node = np.concatenate(kid_node) if kid_node else np.zeros(0, np.int64)
        self.kid_key = np.concatenate(kid_key) if kid_key else np.zeros(0, np.int64)

    def search(self, query: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) at most ``radius`` apart, in parts."""
        at = np.searchsorted(self.tree, tree)
        stack = [(np.arange(len(query)), self.root[at])]
        while stack:
            q, node = stack.pop()
            if len(q) > VISITS:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            if (near := d <= radius).any():
                yield q[near], node[near]
            a, b = self.children[node, 0], self.children[node, 1]
            n = b - a
            if not n.any():
                continue
            q, d, a = np.repeat(q, n), np.repeat(d, n), np.repeat(a, n)
            kid = a + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            ok = np.abs(self.kid_key[kid] - d) <= radius
            if ok.any():
                stack.append((q[ok], self.kid_node[kid[ok]]))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; ``parent`` holds each one's group, the smallest index in it."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


class Sets:
    """Sorted shingle hashes of each row, one after another."""

    def __init__(self, column: pa.ChunkedArray):
        lengths = pc.list_value_length(column).to_numpy().astype(np.int64)
        self.flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.int64) & 0xFFFFFFFF
        self.size, self.start = lengths, np.cumsum(lengths) - lengths

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        n = self.size[rows]
        pair = np.repeat(np.arange(len(rows)), n)
        return (pair << 32) | self.flat[np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def resemble(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the Jaccard similarity of rows a[i] and b[i] is at least SIMILAR."""
        mine, other = self._keys(a), self._keys(b)
        at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
        common = np.bincount((mine >> 32)[other[at] == mine], minlength=len(a))
        return common >= SIMILAR * (self.size[a] + self.size[b] - common)

    def parts(self, a: np.ndarray, b: np.ndarray) -> Iterator[slice]:
        """Cuts of the pairs of about TESTED hashes each."""
        part = np.cumsum(self.size[a] + self.size[b]) // TESTED
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(a)]
        yield from map(slice, cuts[:-1], cuts[1:])


def _shard_links(radius: int, tested: bool = False):
    """Links (a, b) from rows (shard, cell, own, asks, fp, node) sorted by shard and cell: one per fingerprint and group.

    With ``tested``, rows also have their set of shingle hashes, and a link needs two sets that resemble each other.
    """

    def solve(batch: pa.Table) -> pa.RecordBatch:
        shard, cell, own, ask, fp, node = (batch.column(i).to_numpy() for i in range(6))
        fp = fp.view(np.uint64)
        new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1])])
        tree = np.cumsum(new) - 1
        inside = np.nonzero(own)[0]
        used = np.isin(tree, tree[inside])
        forest = Forest(tree[inside], fp[inside])
        parent = np.arange(len(fp))
        asks = np.nonzero(used & ask)[0]
        sets = Sets(batch.column(6)) if tested else None
        for q, found in forest.search(fp[asks], tree[asks], radius):
            a, b = asks[q], inside[found]
            if sets is None:
                _union(parent, a, b)
                continue
            apart = (a != b) & (np.minimum(sets.size[a], sets.size[b]) >= SIMILAR * np.maximum(sets.size[a], sets.size[b]))
            a, b = a[apart], b[apart]
            for part in sets.parts(a, b):
                # What is in one group already needs no test.
                new = parent[a[part]] != parent[b[part]]
                x, y = a[part][new], b[part][new]
                if len(x):
                    ok = sets.resemble(x, y)
                    _union(parent, x[ok], y[ok])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        linked = parent != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= TASK_ROWS or size >= TASK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                shard, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
                ends = np.nonzero((shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1]))[0]
                if len(ends):  # the last cell may go on in the next batch
                    cut = int(ends[-1]) + 1
                    yield solve(table.slice(0, cut))
                    held, rows = table.slice(cut).to_batches(), table.num_rows - cut
                    size = size * rows // table.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect every two of ``nodes`` (node, fp; fp unique) at most ``radius`` bits apart, directly or by others."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in kept) for kept in itertools.combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    dealt = nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", F.xxhash64("k.i", "k.bits").alias("shard"))
    return _meet(dealt, radius, shard_rows)


def _meet(dealt: DataFrame, radius: int, shard_rows: int, sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links among rows (node, fp, shard) of the same shard; with ``sets``, which gives (of, set) for nodes, among those whose sets resemble."""
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stage(sizes.select(F.col("shard").alias("in"), F.ceil(F.col("n") / shard_rows).cast("int").alias("cells")), "shards")
    # What is alone in its shard meets nothing. In a split shard every two parts meet in a cell of their own, where
    # one of them is the tree and the other visits it.
    placed = dealt.join(sizes, dealt["shard"] == sizes["in"]).withColumn("home", F.pmod(F.xxhash64("fp", "node"), F.col("cells")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    low, high = F.least("home", "other"), F.greatest("home", "other")
    placed = placed.select("shard", (low * F.col("cells") + high).alias("cell"), (F.col("home") == high).alias("own"), (F.col("home") == low).alias("asks"), "fp", "node")
    if sets is not None:
        placed = stage(placed, "placed")
        table = stage(sets(placed.select("node").distinct()), "sets")
        placed = placed.join(table.hint("merge"), placed["node"] == table["of"]).drop("of")
    return placed.repartition("shard", "cell").sortWithinPartitions("shard", "cell").mapInArrow(_shard_links(radius, sets is not None), "a long, b long")


def comparisons(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, wide, orders): what brings texts together for :func:`one_of_each`."""
    # Factors that have nothing to do with each other: of multiples of one factor, what is small under one is under all.
    mixers = np.array([xxhash.xxh64_intdigest(bytes([i]), 42) | 1 for i in range(ORDERS)], np.uint64)[:, None]

    def one(text: bytes | None) -> tuple:
        few, hashes = majority(shingle_hashes(text)), shingle_hashes(text, WIDE_SHINGLE)
        if not len(hashes):
            return few, 0, None
        spread = hashes * mixers
        # Over the set, as the similarity is: repeats would set apart what is alike.
        return few, majority(np.unique(hashes)), (spread ^ (spread >> np.uint64(31))).min(1).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            bits = lambda i: pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64))
            orders = pa.array([f[2] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits(0), bits(1), orders], names=["doc_id", "text_hash", "fp", "wide", "orders"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long, wide long, orders array<long>")


def shingle_sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(of, set): the sorted 32-bit shingle hashes of each text whose hash is a ``node`` of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, WIDE_SHINGLE) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["of", "set"])

    wanted = docs.select(F.xxhash64("text").alias("of"), "text").join(texts.hint("merge"), F.col("of") == F.col("node"), "left_semi")
    return wanted.mapInArrow(run, "of long, set array<int>").groupBy("of").agg(F.first("set").alias("set"))


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the group of each fingerprint, named by the smallest one in it."""
    nodes = stage(prints.select("fp").distinct().select(F.col("fp").alias("node"), "fp"), "nodes")
    roots = components(near_links(nodes, radius))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id that links reach.

    Null text counts as text without words: fingerprint zero. Rows with a null doc_id get their fingerprint and
    link like any other, but carry no id: a group of them alone has a null component. Repeated rows give repeated rows.
    An empty table gives no rows; other columns are not read.
    """
    prints = stage(fingerprints(docs), "prints")
    named = groups(prints, radius)
    named = stage(named.join(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp"), "named")
    least = stage(named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "group"), "least")
    known = stage(named.join(least, named["root"] == least["group"]).select(F.col("fp").alias("of"), "component_id"), "known")
    out = prints.join(known, prints["fp"] == known["of"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest doc_id, null last.

    Two texts are in one group if their fingerprints link, or the Jaccard similarity of their five-word shingles is
    ``SIMILAR`` or more, directly or by others.
    """
    prints = stage(comparisons(docs), "comparisons")
    texts = stage(prints.groupBy("text_hash").agg(*[F.first(c).alias(c) for c in ("fp", "wide", "orders")]), "texts")
    named = stage(texts.groupBy("fp").agg(F.min("text_hash").alias("node")), "nodes")
    same = texts.join(named.withColumnRenamed("fp", "of"), texts["fp"] == F.col("of")).where("text_hash <> node").select(F.col("text_hash").alias("a"), F.col("node").alias("b"))
    keyed = texts.select(F.col("text_hash").alias("node"), F.col("wide").alias("fp"), F.posexplode("orders").alias("order", "least"))
    keyed = keyed.select("node", "fp", F.xxhash64("order", "least").alias("shard"))
    alike = _meet(keyed, WIDE_RADIUS, WIDE_SHARD_ROWS, lambda texts: shingle_sets(docs, texts))
    roots = components(near_links(named, radius).union(same).union(alike))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")).alias("first")
    placed = prints.select("doc_id", "text_hash").join(roots, prints["text_hash"] == roots["node"], "left")
    stay = placed.groupBy(F.coalesce("root", "text_hash").alias("root")).agg(first).select("first.doc_id", "first.text_hash")
    stay = stage(stay, "stay")
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]) & (F.xxhash64(docs["text"]) == stay["text_hash"]), "left_semi")
