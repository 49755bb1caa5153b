"""Source divergence audit (operator 11): hash-consed segment trees over term ids.

1. Tasks count the terms of their documents per (lang, source) and hand on sums, so a source that holds a third of all
   documents is shuffled as one row per term and task. A language keeps the terms of at least ``LEAST_DOCS`` documents.
2. A language's kept terms are dealt by hash to blocks of about ``WIDTH`` terms; in a block, a term's id is its place in order.
   A block holds the counts of all sources of the language, so it is bounded by ``WIDTH`` times the sources.
3. In a block every source is a segment tree of its counts. Trees are hash-consed: a node is its two children, equal nodes are
   one whatever source or place they stand in, so a subtree of zeros, or of any counts that come again, is stored once.
4. Two trees are priced by walking them together from the roots. A pair of nodes that is met again in the walk is not walked
   again: it is one entry with a number of times, and at the leaves each pair of counts is priced once. A block adds its
   price to the pair's sum in a combined aggregate.

A lang's own counts are one more tree, walked together with each source's tree for the terms that stand out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import drop_staged, stage

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
WIDTH = 4096
# Entries that a task counts before it hands them on, and node pairs that a walk holds at a time.
HELD_TERMS = 400_000
WALKED = 2_000_000

_TO_TERMS = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_TO_TERMS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed as far as one task saw them; term '' stands for the group itself."""
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, in_docs) in held.items():
            terms = [b"", *counts]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *counts.values()], [0, *(in_docs[t] for t in counts)]]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays[2] = arrays[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                counts, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                terms = Counter(terms_of(text.as_py()))
                counts.update(terms)
                in_docs.update(terms.keys())
                size += len(counts) - before
                if size >= HELD_TERMS:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")


class Trees:
    """Hash-consed segment trees over the rows of a matrix of counts; its width is a power of two.

    ``levels[k]`` holds the two children of every different node of level k + 1, as numbers in level k. ``leaves`` holds
    the different counts, and ``root`` the number of each row's root in the last level.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, at = np.unique(counts, return_inverse=True)
        at = at.reshape(counts.shape)
        self.levels: list[np.ndarray] = []
        while at.shape[1] > 1:
            left, right = at[:, ::2], at[:, 1::2]
            size = int(at.max()) + 1
            nodes, number = np.unique(left.astype(np.int64) * size + right, return_inverse=True)
            self.levels.append(np.stack([nodes // size, nodes % size], 1))
            at = number.reshape(left.shape)
        self.root = at[:, 0]

    def walk(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Trees a[i] and b[i] walked together: (i, leaf of a, leaf of b, times), each pair of leaves of a walk once."""
        walk, x, y, times = np.arange(len(a)), self.root[a], self.root[b], np.ones(len(a), np.int64)
        for nodes in reversed(self.levels):
            walk, times = np.tile(walk, 2), np.tile(times, 2)
            x, y = np.concatenate([nodes[x, 0], nodes[x, 1]]), np.concatenate([nodes[y, 0], nodes[y, 1]])
            # The memo: what was met before in this walk is counted, not walked again.
            order = np.lexsort((y, x, walk))
            walk, x, y, times = walk[order], x[order], y[order], times[order]
            new = np.concatenate([[True], (walk[1:] != walk[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            first = np.flatnonzero(new)
            times = np.add.reduceat(times, first)
            walk, x, y = walk[first], x[first], y[first]
        return walk, x, y, times


def share(count: int, total: int, kept: int) -> int:
    """p of the contract; counts are Python's numbers, which do not overflow."""
    return 1 + SCALE * (count + 2) // (total + 2 * kept)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shares(counts: np.ndarray, row: np.ndarray, leaf: np.ndarray, totals: list[int], kept: int) -> np.ndarray:
    """p of counts[leaf] in tree ``row``; each different (row, leaf) is computed once."""
    code, back = np.unique(row * len(counts) + leaf, return_inverse=True)
    known = [share(int(counts[c % len(counts)]), totals[c // len(counts)], kept) for c in code.tolist()]
    return np.array(known, np.int64)[back]


def price_block(sources: list[str], totals: list[int], kept: int, source: np.ndarray, term: np.ndarray, n: np.ndarray, terms: list[str], top: int):
    """Prices of one block of a language: pairs (a, b, value) with a < b, and the best terms (source, term, value).

    ``totals`` has one entry for each source and a last one for the language; ``source``, ``term`` and ``n`` list the counts.
    """
    groups, width = len(sources), 1
    while width < len(terms):
        width *= 2
    counts = np.full((groups + 1, width), -1, np.int64)  # what fills up to a power of two is no term
    counts[:, : len(terms)] = 0
    counts[source, term] = n
    counts[groups, : len(terms)] = counts[:groups, : len(terms)].sum(0)
    trees = Trees(counts)
    pairs = []
    a, b = np.triu_indices(groups, 1)
    step = max(1, WALKED // width)
    for at in range(0, len(a), step):
        i, j = a[at : at + step], b[at : at + step]
        value = np.zeros(len(i), np.int64)
        if terms:
            walk, x, y, times = trees.walk(i, j)
            real = trees.leaves[x] >= 0
            walk, x, y, times = walk[real], x[real], y[real], times[real]
            p, q = (_shares(trees.leaves, t[walk], leaf, totals, kept) for t, leaf in ((i, x), (j, y)))
            np.add.at(value, walk, price(p, q) * times)
        pairs.append((i, j, value))
    best: list[tuple[int, str, int]] = []
    if terms:
        walk, x, y, _ = trees.walk(np.arange(groups), np.full(groups, groups))
        real = trees.leaves[x] > 0
        walk, x, y = walk[real], x[real], y[real]
        p, q = _shares(trees.leaves, walk, x, totals, kept), _shares(trees.leaves, np.full(len(walk), groups), y, totals, kept)
        over = p > q
        size = len(trees.leaves)
        known = dict(zip(((walk * size + x) * size + y)[over].tolist(), price(p, q)[over].tolist()))
        own = np.searchsorted(trees.leaves, counts)
        per: dict[int, list] = {}
        for g, t in zip(source.tolist(), term.tolist()):
            if (value := known.get((g * size + int(own[g, t])) * size + int(own[groups, t]))) is not None:
                per.setdefault(g, []).append((-value, terms[t].encode(), terms[t]))
        best = [(g, t, -v) for g, of in per.items() for v, _, t in sorted(of)[:top]]
    return pairs, best


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and the terms by which each stands out.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms. Null text, lang and source are ''.
    Rows that repeat are documents of their own; doc_id is not read. A language without kept terms has pairs of value 0.
    Ties go by the item's UTF-8 bytes. An empty table gives no rows; other columns are not read.
    """
    counted = stage(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("d")).where(F.col("d") >= least_docs)
    kept = stage(kept.select(F.col("lang").alias("of"), F.col("term").alias("kept_term")), "kept")
    size = kept.groupBy("of").agg(F.count("*").alias("v"))
    used = counted.join(kept.hint("merge"), (counted["lang"] == kept["of"]) & (counted["term"] == kept["kept_term"])).select("lang", "source", "term", "n")
    used = stage(used, "used")
    totals = used.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("total"))
    groups = counted.where("term = ''").select("lang", "source")
    groups = groups.join(totals, (groups["lang"] == totals["l"]) & (groups["source"] == totals["s"]), "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    groups = groups.join(size, groups["lang"] == size["of"], "left").select("lang", "source", "total", F.coalesce("v", F.lit(0)).alias("v"))
    groups = stage(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / width)).cast("int")), "groups")
    drop_staged(counted, kept)
    # Every block of a language needs all its sources, also those without a term in it.
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "v")
    blocks = groups.groupBy(F.col("lang").alias("l")).agg(F.first("blocks").alias("blocks"))
    placed = used.join(blocks, used["lang"] == blocks["l"]).select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", F.lit(0).cast("long").alias("v"))

    def solve(table: pa.Table) -> pa.Table:
        head = table.column("term").is_null()
        own, rest = table.filter(head), table.filter(pc.invert(head))
        sources = sorted(own.column("source").to_pylist(), key=str.encode)
        total = dict(zip(own.column("source").to_pylist(), own.column("n").to_pylist()))
        totals = [total[s] for s in sources]
        number = {s: i for i, s in enumerate(sources)}
        terms = sorted(set(rest.column("term").to_pylist()), key=str.encode)
        place = {t: i for i, t in enumerate(terms)}
        at = np.array([number[s] for s in rest.column("source").to_pylist()], np.int64)
        of = np.array([place[t] for t in rest.column("term").to_pylist()], np.int64)
        pairs, best = price_block(sources, [*totals, sum(totals)], own.column("v")[0].as_py(), at, of, rest.column("n").to_numpy(), terms, top)
        names = np.array(sources, object)
        lists = [(names[i], names[j], value) for i, j, value in pairs] + [(names[j], names[i], value) for i, j, value in pairs]
        join = lambda k, more: [x for part in lists for x in part[k].tolist()] + more
        source, item, value = join(0, [sources[g] for g, _, _ in best]), join(1, [t for _, t, _ in best]), join(2, [v for _, _, v in best])
        part = ["pair"] * (len(source) - len(best)) + ["term"] * len(best)
        lang = [own.column("lang")[0].as_py()] * len(source)
        return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    priced = heads.unionByName(placed).groupBy("lang", "block").applyInArrow(solve, "lang string, source string, part string, item string, value long")
    summed = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    # The best of a block are at most ``top`` of each source, so few rows are ranked.
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
