"""Document fingerprints (operator 12) by a randomised edit embedding.

All texts are walked with the same random bits: at step j the walk writes the character it stands on, and a bit that depends
on j and on the character says whether it goes on to the next one. Texts that differ by an edit fall out of step there and
soon into step again, so a small edit distance becomes a small Hamming distance between what the walks write.

A walk of n characters takes about 2 n steps. A fingerprint holds what is written at ``SAMPLES`` of them: of the steps up to the
text's length class, those that come first in one random order. Classes are a quarter of an octave apart, and the sample of a
longer class cut off at a shorter one is part of that one's sample, so fingerprints of any two lengths compare on shared steps.
The likeness of two is the share of steps, of those at which either text is still being read, that hold the same character.

Likely partners are found by bands of sampled steps, each read with the text's own class and the next, so that lengths up to a
fifth apart meet; the likeness of whole fingerprints verifies them.

Spark orders the documents by ranges of ids and brings each range, and the first document of the next, to a task; texts are
shuffled once. A task streams through its range and holds a block of documents at a time, whose walks go on side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import components, stage

SAMPLES = 256
BANDS = 8
BAND_SAMPLES = 8
ALIKE = 0.9
# The walk's bits repeat after PERIOD steps; characters share them in CLASSES classes.
PERIOD = 1 << 14
CLASSES = 256
SEED = 12
# Characters of one block of documents, and of a text whose places are looked up at a time; walks that still go on together.
BLOCK_CHARS = 4_000_000
WALKED = 1 << 20
TOGETHER = 24
# Bytes of text in a range of ids.
RANGE_BYTES = 32 << 20
MOST_RANGES = 20_000  # ranges grow beyond that
CELL_ROWS = 4096
NOTHING = 0


@lru_cache(1)
def waits() -> np.ndarray:
    """For each class of characters and step j: how many steps a walk that comes at step j stays."""
    go = np.random.default_rng(SEED).random((CLASSES, PERIOD)) < 0.5
    out = np.empty((CLASSES, PERIOD), np.uint8)
    for line, row in zip(go, out):
        at = np.flatnonzero(line)
        upcoming = np.append(at, at[0] + PERIOD)[np.searchsorted(at, np.arange(PERIOD))]
        row[:] = np.minimum(upcoming - np.arange(PERIOD) + 1, 255)
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1 << 16)
def length_class(n: int) -> int:
    """The smallest class whose length is ``n`` or more."""
    c = max(0, int(np.floor(4 * np.log2(max(n, 1)))) - 1)
    while class_length(c) < n:
        c += 1
    while c and class_length(c - 1) >= n:
        c -= 1
    return c


def class_length(c: int) -> int:
    return int(np.ceil(2 ** (c / 4)))


@lru_cache(256)
def steps(c: int) -> np.ndarray:
    """The sampled steps of a class in order: of the first 2 n, the ``SAMPLES`` that a random order puts first."""
    upto, best = 2 * class_length(c), np.zeros(0, np.uint64)
    for at in range(0, upto, 1 << 20):
        here = np.arange(at, min(upto, at + (1 << 20)), dtype=np.uint64)
        best = np.concatenate([best, here])
        rank = _mixed(best + np.uint64(0x9E3779B97F4A7C15))
        best = best[np.argsort(rank, kind="stable")[:SAMPLES]]
    return np.sort(best).astype(np.int64)


def classes_of(codes: np.ndarray) -> np.ndarray:
    return (_mixed(codes.astype(np.uint64) + np.uint64(1)) & np.uint64(CLASSES - 1)).astype(np.uint8)


def walks(texts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
    """How many steps each character takes in walks over ``texts``, given as classes, that begin at the given steps.

    All walks go on together, one character of each at a time, the longest first; the last few are finished one by one.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flat = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, np.uint8)
    at = np.array([begin[i] for i in order], np.int64)
    stays, table, mask = np.empty(len(flat), np.uint8), waits(), PERIOD - 1
    rising, n, k = -sizes, int((sizes > 0).sum()), 0
    while n >= TOGETHER:
        here = starts[:n] + k
        stay = table[flat[here], at[:n] & mask]
        stays[here] = stay
        at[:n] += stay
        k += 1
        n = int(np.searchsorted(rising[:n], -k))  # those longer than k
    rows = [row.tobytes() for row in table] if n else []
    for w in range(n):
        t, rest = int(at[w]), bytearray()
        put = rest.append
        for row in map(rows.__getitem__, flat[starts[w] + k : ends[w]].tobytes()):
            stay = row[t & mask]
            t += stay
            put(stay)
        stays[starts[w] + k : ends[w]] = np.frombuffer(rest, np.uint8)
    out: list = [None] * len(order)
    for i, a, b in zip(order, starts.tolist(), ends.tolist()):
        out[i] = stays[a:b]
    return out


def written(codes: np.ndarray, stays: np.ndarray, begin: int, asked: np.ndarray) -> np.ndarray:
    """What a walk writes at the asked steps; NOTHING before it begins and after it ends."""
    out = np.full(len(asked), NOTHING, np.uint8)
    for start in range(0, len(codes), WALKED):
        left = begin + np.cumsum(stays[start : start + WALKED], dtype=np.int64)  # the step at which each character is left
        lo, hi = np.searchsorted(asked, (begin, left[-1]))
        if hi > lo:
            on = codes[start + np.searchsorted(left, asked[lo:hi], side="right")]
            out[lo:hi] = 1 + (_mixed(on.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)).astype(np.int64) % 255
        begin = int(left[-1])
    return out


def printed(values: np.ndarray, n: int) -> str:
    """A fingerprint: the length class and two hexadecimal digits for each sampled step."""
    return f"{length_class(n):02x}:{values.tobytes().hex()}" if n else "00:"


def read_print(fingerprint: str) -> tuple[int, np.ndarray]:
    c, _, digits = fingerprint.partition(":")
    return int(c, 16), np.frombuffer(bytes.fromhex(digits), np.uint8)


def prints_of(codes: list[np.ndarray], stays: list[np.ndarray]) -> list[str]:
    return [printed(written(c, w, 0, steps(length_class(len(c)))) if len(c) else c, len(c)) for c, w in zip(codes, stays)]


def fingerprint(text: str) -> str:
    codes = codes_of(text)
    return prints_of([codes], walks([classes_of(codes)], [0]))[0]


def sampled_at(c: int, written: np.ndarray, longer: int) -> np.ndarray:
    """A sample of class ``c`` at the steps of a longer class; where the shorter class ends, its text has nothing any more."""
    if c == longer or not len(written):
        return written
    own, at_steps = steps(c), steps(longer)
    at = np.minimum(np.searchsorted(own, at_steps), len(own) - 1)
    return np.where(own[at] == at_steps, written[at], NOTHING).astype(np.uint8)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal characters along the last axis, of the steps at which either text is still read; 0 if there are none."""
    some = (a != NOTHING) | (b != NOTHING)
    return ((a == b) & some).sum(-1) / np.maximum(some.sum(-1), 1)


def likeness(a: str, b: str) -> float:
    """Share of equal characters at the shared sample of two fingerprints, 0 to 1; equal fingerprints have 1."""
    if a == b:
        return 1.0
    (ca, wa), (cb, wb) = sorted((read_print(a), read_print(b)), key=lambda x: x[0])
    if not len(wa) or not len(wb):
        return 0.0
    return float(agreement(sampled_at(ca, wa, cb), wb))


def compare(docs: list[tuple[int | None, str]]) -> Iterator[tuple]:
    """Rows of all but the last of ``docs`` (doc_id, text), each with the one behind it as its next.

    The edited text is the text with its last third replaced by the beginning of the next. Its walk goes along the text's
    own walk up to the cut.
    """
    codes = [codes_of(text) for _, text in docs]
    classes = [classes_of(c) for c in codes]
    stays = walks(classes, [0] * len(docs))
    prints = prints_of(codes, stays)
    thirds = [len(c) // 3 for c in codes]
    keeps = [len(c) - k for c, k in zip(codes, thirds)]
    cuts = [int(w[:keep].sum(dtype=np.int64)) for w, keep in zip(stays, keeps)]
    forks = walks([after[:k] for after, k in zip(classes[1:], thirds)], cuts[:-1])
    for i, fork in enumerate(forks):
        (doc_id, text), (_, after), keep, cut = docs[i], docs[i + 1], keeps[i], cuts[i]
        n = keep + len(fork)
        asked = steps(length_class(n))
        both = np.maximum(written(codes[i][:keep], stays[i][:keep], 0, asked), written(codes[i + 1][: len(fork)], fork, cut, asked))
        edited, changed = text[:keep] + after[: thirds[i]], printed(both, n)
        hashed = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        yield doc_id, len(codes[i]), hashed, prints[i], changed, likeness(prints[i], changed), likeness(prints[i], prints[i + 1]), edited


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_text string"


def ordered_ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, guest, absent, doc_id, h, text): documents dealt to ranges of the order by descending id.

    Rows of one id go by the text's hash, rows without an id come last. A range also gets the first document of the next
    one, and the last range the first of all, as its guest. Ranges are Spark's own of a sample of keys; only their first
    keys come to the driver, one for each ``range_bytes`` of text.
    """
    rows = docs.select(F.col("doc_id").isNull().alias("absent"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("absent"), F.desc("doc_id"), F.col("h")]
    keys = stage(rows.select("absent", "doc_id", "h", F.octet_length("text").alias("size")), "keys")
    size = keys.agg(F.sum("size").alias("b")).collect()[0]["b"]
    parts = min(max(1, -(-(size or 0) // range_bytes)), MOST_RANGES)
    spread = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("p"))
    value = F.when(F.col("absent"), F.lit(1)).otherwise(F.lit(0)).alias("absent"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), F.col("h")
    firsts = sorted((r["k"]["absent"], r["k"]["down"], r["k"]["h"]) for r in spread.agg(F.min(F.struct(*value)).alias("k")).collect())
    starts = np.array(firsts or [(0, 0, 0)], dtype=[("absent", "i8"), ("down", "i8"), ("h", "i8")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            absent = batch.column(0).cast(pa.int8()).to_numpy(zero_copy_only=False).astype(np.int64)
            down = ~pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
            own = np.empty(batch.num_rows, starts.dtype)
            own["absent"], own["down"], own["h"] = absent, down, batch.column(3).to_numpy()
            part = np.maximum(np.searchsorted(starts, own, side="right") - 1, 0)
            leads = np.flatnonzero(starts[part] == own)
            at = np.concatenate([np.arange(batch.num_rows), leads])
            to = np.concatenate([part, (part[leads] - 1) % len(starts)]).astype(np.int32)
            guest = np.arange(len(at)) >= batch.num_rows
            columns = [pa.array(to), pa.array(guest), *(batch.column(i).take(pa.array(at)) for i in (0, 1, 3, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "guest", "absent", "doc_id", "h", "text"])

    dealt = rows.mapInArrow(deal, "part int, guest boolean, absent boolean, doc_id long, h long, text string")
    # A guest comes behind the range's own rows; a range that begins with rows alike has them all as guests, and needs one.
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", *order, "text")


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_text.

    The next document is the one with the next smaller doc_id, after the last the first; rows without an id come last, and
    rows of one id go by their text's hash. Null text is the empty text. A document alone is its own next. Two empty texts
    are alike, an empty one and another are not. An empty table gives no rows; other columns are not read.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def solved(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(docs) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*compare(docs)), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = None, [], 0
        for batch in batches:
            for at, guest, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(5)):
                if at != part:
                    part = at
                elif not block:  # a further guest
                    continue
                text = text.as_py()
                block.append((doc_id, text))
                held += len(text)
                if guest or held >= BLOCK_CHARS:
                    yield from solved(block)
                    block, held = ([], 0) if guest else ([block[-1]], len(text))

    return ordered_ranges(docs, range_bytes).mapInArrow(run, SCHEMA)


@lru_cache(256)
def band_steps(c: int) -> np.ndarray:
    """For each band the places in the sample of a class that it reads."""
    n = len(steps(c))
    return np.random.default_rng(SEED + c).integers(0, n, (BANDS, BAND_SAMPLES))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, classes = [], []
        for text in batch.column(1).to_pylist():
            c, written = read_print(text)
            for longer in (c, c + 1) if len(written) else ():
                seen = sampled_at(c, written, longer)[band_steps(longer)]
                number = np.arange(BANDS, dtype=np.uint64) + np.uint64(longer * BANDS)
                keys.append(_mixed(np.ascontiguousarray(seen).view("<u8")[:, 0] ^ _mixed(number)).view(np.int64))
                classes.append(longer)
        of = np.repeat(batch.column(0).to_numpy(), [2 * BANDS if len(t) > 3 else 0 for t in batch.column(1).to_pylist()])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(classes, BANDS).astype(np.int32)), pa.array(of)], names=["key", "class", "node"])


def _heads(alike: float):
    """Links (key, a, b) of each bucket's rows to the first row that is like them; a row that is like none is a head and links to itself."""

    def solve(table: pa.Table) -> pa.Table:
        c = table.column("class")[0].as_py()
        node = table.column("node").to_numpy()
        rows = np.array([sampled_at(*read_print(t), c) for t in table.column("fingerprint").to_pylist()])
        left, a, b = np.arange(len(node)), [], []
        while len(left):
            near = agreement(rows[left], rows[left[0]]) >= alike
            near[0] = True
            a.append(node[left[near]])
            b.append(np.full(int(near.sum()), node[left[0]]))
            left = left[~near]
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"key": pa.array(np.full(len(a), table.column("key")[0].as_py())), "class": pa.array(np.full(len(a), c, np.int32)), "a": pa.array(a), "b": pa.array(b)})

    return solve


def near_groups(prints: DataFrame, alike: float = ALIKE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fingerprint, group_id) of every row: group_id is the smallest doc_id reached over fingerprints ``alike`` or more.

    ``prints`` has doc_id and fingerprint. Equal fingerprints are one node. Nodes meet where a band of sampled steps is equal;
    in a bucket each is compared with the bucket's heads, the first of their kind. A bucket of many is cut into cells of
    bounded size, and the heads of its cells meet once more. Two texts of likeness 0.9 share none of 8 bands of 8 steps in
    about one case of ninety, of 0.95 in one of ten thousand; that one edit sends a walk out of step for so long that the
    likeness stays below is a matter of chance too, about one case of fifty for a single character. A group of rows without ids has a null group_id.
    """
    nodes = stage(prints.select("fingerprint").distinct().select(F.monotonically_increasing_id().alias("node"), "fingerprint"), "nodes")
    keys = stage(nodes.select("node", "fingerprint").mapInArrow(_bands, "key long, class int, node long"), "bands")
    busy = keys.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("cells"), F.count("*").alias("n")).where("n > 1")
    met = keys.join(busy, keys["key"] == busy["k"]).select("key", "class", F.col("node").alias("of"), "cells", F.pmod(F.xxhash64("node"), F.col("cells")).alias("cell"))
    schema = "key long, class int, a long, b long"
    rows = met.join(nodes, F.col("of") == nodes["node"])
    links = stage(rows.select("key", "class", "cells", "cell", "node", "fingerprint").groupBy("key", "cell").applyInArrow(_heads(alike), schema), "links")
    split = busy.where("cells > 1")
    heads = links.where("a = b").join(split, links["key"] == split["k"], "left_semi").select("key", "class", F.col("a").alias("of"))
    heads = heads.join(nodes, F.col("of") == nodes["node"]).select("key", "class", "node", "fingerprint").groupBy("key").applyInArrow(_heads(alike), schema)
    roots = components(links.select("a", "b").union(heads.select("a", "b")).where("a <> b"))
    named = nodes.join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(F.col("fingerprint").alias("print"), F.coalesce("root", "node").alias("group"))
    placed = stage(prints.join(named, prints["fingerprint"] == named["print"]).select("doc_id", "fingerprint", "group"), "placed")
    least = placed.groupBy(F.col("group").alias("g")).agg(F.min("doc_id").alias("group_id"))
    return placed.join(least, placed["group"] == least["g"]).select("doc_id", "fingerprint", "group_id")
