"""Removing repeated passages (operator 1) by recompression.

Recompression rewrites a word sequence in rounds: first every maximal run of one symbol becomes a symbol, then every pair
whose left symbol is of the left class and whose right symbol is of the right class. A symbol's class in a round is a bit
of its name, and a symbol's name is a fingerprint of the words it stands for, so any two tasks give the same substring the
same name and the rounds need no dictionary passed around. Equal passages get equal symbols except near their ends.

1. Spark names symbols: each document yields its symbols of one low level and its high-level symbols of ``window`` words
   or more. An aggregate over the names finds those that more than one document holds, and the smallest such document.
2. High-level symbols whose smallest document is another one are repeats as they stand. A low-level symbol that only one
   document holds rules out every window that must contain it, because a symbol's neighbourhood says which words decide it.
3. Only windows that neither rules out are compared word for word, by a fingerprint of all their words.

Fingerprints are 93 bits, of polynomials modulo a prime. Names that many documents share stay balanced: minima are combined before the shuffle, and the
joins back to them are plain equi joins of stored tables, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_staged, stage

WINDOW = 50
# Rounds until the low level (symbols of about ten words), and rounds between two high levels.
LOW_ROUNDS = 8
HIGH_STEP = 3
GROUP_WORDS = 200_000
FAR = 1 << 40

U = np.uint64
# Three polynomials modulo a prime: modulo a power of two some regular sequences have equal values at every base.
PRIME = U((1 << 31) - 1)
BASES = (1_268_112_683, 846_930_886, 1_957_747_793)
MIX = U(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MIX
    return x ^ (x >> U(29))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, which is one less than a power of two."""
    for _ in range(2):
        x = (x & PRIME) + (x >> U(31))
    x = (x & PRIME) + (x >> U(31))
    return np.where(x == PRIME, U(0), x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate([out, _reduced(out * U(pow(base, len(out), int(PRIME))))])
    return out[:n]


class Words:
    """The words of a group of documents as one array of hashes, with fingerprints of any span."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").split() for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        hashed = [xxhash.xxh3_64_intdigest(w) for ws in split for w in ws]
        self.hash = np.array(hashed, dtype=U)
        self.doc = np.repeat(np.arange(len(split)), self.counts)
        n = len(self.hash)
        self._lanes = []
        for base in BASES:
            values = _reduced(_reduced(_mix(self.hash + U(base))) * _powers(base, n))
            sums = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
            self._lanes.append((sums, _powers(pow(base, -1, int(PRIME)), n + 1)))

    def _polynomial(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        sums, inverse = self._lanes[lane]
        return _reduced(_reduced(sums[end] - sums[start]) * inverse[start])

    def fingerprint(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62 bits of the words of each span, and its length."""
        return _mix((self._polynomial(start, end, 0) << U(31) | self._polynomial(start, end, 1)) + ((end - start).astype(U) << U(48)))

    def check(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """31 more bits."""
        return self._polynomial(start, end, 2)


def _runs(w: Words, name, s, e, lo, hi):
    """Maximal runs of one name become one symbol. lo and hi: the words that decide a symbol, or None."""
    same = (name[1:] == name[:-1]) & (w.doc[s[1:]] == w.doc[s[:-1]])
    if lo is not None:
        # That the neighbour differs shows in its nearest word, or else takes the whole neighbour.
        first, last = s == w.starts[w.doc[s]], e == w.ends[w.doc[s]]
        left, right = np.roll(lo, 1), np.roll(hi, -1)
        before, after = np.maximum(s - 1, 0), np.minimum(e, len(w.hash) - 1)
        lo = np.where(first, -FAR, np.minimum(lo, np.where(w.hash[before] != w.hash[e - 1], s - 1, left)))
        hi = np.where(last, FAR, np.maximum(hi, np.where(w.hash[after] != w.hash[s], e + 1, right)))
    if not same.any():
        return name, s, e, lo, hi
    at = np.nonzero(np.concatenate([[True], ~same]))[0]
    end = np.concatenate([at[1:], [len(s)]]) - 1
    grown = at != end
    s, e, name = s[at], e[end], name[at]
    name[grown] = w.fingerprint(s[grown], e[grown])
    return (name, s, e, None, None) if lo is None else (name, s, e, np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at))


def _pairs(w: Words, name, s, e, lo, hi, turn: int):
    """Neighbours of the left and the right class become one symbol."""
    left = (_mix(name + U(0x632BE59BD9B4E019 * (turn + 1) % (1 << 64))) >> U(63)).astype(bool)
    inside = w.doc[s[1:]] == w.doc[s[:-1]]
    pair = np.concatenate([left[:-1] & ~left[1:] & inside, [False]])
    second = np.concatenate([[False], pair[:-1]])
    keep = np.nonzero(~second)[0]
    if lo is not None:
        # A pair is decided by its two symbols; a lone one of the left class by its right neighbour too, and the reverse.
        ends = np.concatenate([~inside, [True]])
        starts = np.concatenate([[True], ~inside])
        next_lo, next_hi = np.where(ends, lo, np.roll(lo, -1)), np.where(ends, FAR, np.roll(hi, -1))
        last_lo, last_hi = np.where(starts, -FAR, np.roll(lo, 1)), np.where(starts, hi, np.roll(hi, 1))
        lo, hi = np.minimum(lo, np.where(left, next_lo, last_lo))[keep], np.maximum(hi, np.where(left, next_hi, last_hi))[keep]
    e = np.where(pair, np.concatenate([e[1:], e[-1:]]), e)[keep]
    name, s, grown = name[keep], s[keep], pair[keep]
    name[grown] = w.fingerprint(s[grown], e[grown])
    return name, s, e, lo, hi


def parse(w: Words, window: int = WINDOW, low_rounds: int = LOW_ROUNDS, step: int = HIGH_STEP):
    """Low-level symbols (start, end, first and last deciding word) and high-level ones (start, end) of a group."""
    n = len(w.hash)
    s, e = np.arange(n), np.arange(1, n + 1)
    name, lo, hi = w.fingerprint(s, e), s.copy(), e.copy()
    low, high, before = None, [], 0
    turn = 0
    while n:
        name, s, e, lo, hi = _runs(w, name, s, e, lo, hi)
        name, s, e, lo, hi = _pairs(w, name, s, e, lo, hi, turn)
        turn += 1
        if turn == low_rounds:
            fit = hi - lo <= window
            low, lo, hi = (s[fit], e[fit], lo[fit], hi[fit]), None, None
        done = turn >= low_rounds and (len(s) == (w.counts > 0).sum())
        if turn >= low_rounds and ((turn - low_rounds) % step == 0 or done):
            span = s * (n + 1) + e
            new = (e - s >= window) & ~np.isin(span, before)
            before = span
            high.append((s[new], e[new]))
        if done:
            break
    none = np.zeros(0, np.int64)
    if low is None:
        return (none,) * 4, (none, none)
    return low, tuple(np.concatenate(x) for x in zip(*high))


def _groups(batches: Iterator[pa.RecordBatch], words: int = GROUP_WORDS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about so many words."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :][: batch.num_rows + 1])
        part = np.cumsum(sizes) // (6 * words)
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _words(batch: pa.RecordBatch) -> Words:
    return Words(batch.column("text").cast(pa.binary()).to_pylist())


def _rows(batch: pa.RecordBatch, w: Words, s: np.ndarray, e: np.ndarray, *names: str) -> pa.RecordBatch:
    """Spans as rows: fingerprint (62 and 31 bits), document, start, number of words."""
    at = w.doc[s]
    doc, sub = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("doc", "sub"))
    k1 = w.fingerprint(s, e).view(np.int64)
    k2 = w.check(s, e).astype(np.int32)
    columns = {"k1": k1, "k2": k2, "doc": doc, "sub": sub, "s": (s - w.starts[at]).astype(np.int32), "n": (e - s).astype(np.int32)}
    return pa.RecordBatch.from_pydict({n: columns[n] for n in names})


def _symbols(window: int, low_rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            w = _words(batch)
            (s, e, _, _), (hs, he) = parse(w, window, low_rounds)
            yield _rows(batch, w, np.concatenate([s, hs]), np.concatenate([e, he]), "k1", "k2", "doc", "sub", "s", "n")

    return run


def _lists(batch: pa.RecordBatch, w: Words, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column of (s << 32 | n) as start and end in the group."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    start = np.repeat(w.starts, lengths) + (flat >> 32)
    return start, start + (flat & 0xFFFFFFFF)


def _windows(window: int, low_rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            w = _words(batch)
            n = len(w.hash)
            (s, _, lo, hi), _ = parse(w, window, low_rounds)
            shared = np.zeros(n + 1, bool)
            shared[_lists(batch, w, "shared")[0]] = True
            own = ~shared[s]
            starts = np.repeat(w.starts, w.counts)[s]
            cs, ce = _lists(batch, w, "covered")
            out = np.zeros(n + 2, np.int64)
            np.add.at(out, np.concatenate([np.maximum(hi[own] - window, starts[own]), cs]), 1)
            np.add.at(out, np.concatenate([lo[own] + 1, ce - window + 1]), -1)
            free = np.cumsum(out)[:n] == 0
            at = np.nonzero(free & (np.arange(n) + window <= np.repeat(w.ends, w.counts)))[0]
            yield _rows(batch, w, at, at + window, "k1", "k2", "doc", "sub", "s")

    return run


def _remove():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column("spans").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            totals, gone, digests, kept = [], [], [], []
            for text, of in zip(texts, spans):
                words = (text or b"").split()
                totals.append(len(words))
                if of:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array(of, np.int64)
                    np.add.at(edge, at >> 32, 1)
                    np.add.at(edge, (at >> 32) + (at & 0xFFFFFFFF), -1)
                    out = np.cumsum(edge)[:-1] > 0
                    words = [x for x, o in zip(words, out.tolist()) if not o]
                gone.append(totals[-1] - len(words))
                kept.append(b" ".join(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, sub): ``doc`` orders rows and (doc, sub) tells different texts apart.

    Where ids do not repeat, an id is enough. The texts of an id that comes again get numbers in a stored table, which they
    find by a 128-bit digest.
    """
    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    again = stage(keyed.groupBy(F.col("doc").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "again")
    if again.isEmpty():
        return keyed.withColumn("sub", F.lit(0).cast("long"))
    hashed = keyed.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = hashed.join(again, hashed["doc"] == again["again"], "left_semi").select(F.col("doc").alias("of"), F.col("digest").alias("known")).distinct()
    texts = stage(texts.withColumn("sub", F.monotonically_increasing_id()), "texts")
    found = hashed.join(texts, (hashed["doc"] == texts["of"]) & (hashed["digest"] == texts["known"]), "left")
    return found.select("doc_id", "text", "doc", F.coalesce("sub", F.lit(0).cast("long")).alias("sub"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, low_rounds: int = LOW_ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each document without the passages of earlier ones.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null text has no words. A null doc_id comes after every other one. Rows that repeat a doc_id take
    nothing from each other, and those with the same text have the same result. An empty table gives no rows; other columns are not read.
    """
    keyed = numbered(docs.select("doc_id", "text"))
    inner = keyed.select("text", "doc", "sub")

    def least(table: DataFrame) -> DataFrame:
        """Names that more than one document holds, with the smallest."""
        return table.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "least")

    def back(table: DataFrame, names: DataFrame, *columns: Column) -> DataFrame:
        return table.join(names, (table["k1"] == names["j1"]) & (table["k2"] == names["j2"])).select(*columns)

    span = F.shiftleft(F.col("s").cast("long"), 32) + F.col("n")
    symbols = stage(inner.mapInArrow(_symbols(window, low_rounds), "k1 long, k2 int, doc long, sub long, s int, n int"), "symbols")
    names = stage(least(symbols), "names")
    found = back(symbols, names, "doc", "sub", span.alias("span"), (F.col("n") <= window).alias("low"), ((F.col("n") >= window) & (F.col("least") < F.col("doc"))).alias("gone"))
    flags = stage(found.groupBy("doc", "sub").agg(F.collect_list(F.when(F.col("low"), F.col("span"))).alias("shared"), F.collect_list(F.when(F.col("gone"), F.col("span"))).alias("covered")), "flags")
    drop_staged(symbols, names)

    marked = inner.join(flags, ["doc", "sub"], "left")
    windows = stage(marked.mapInArrow(_windows(window, low_rounds), "k1 long, k2 int, doc long, sub long, s int"), "windows")
    names = stage(least(windows), "names")
    hits = back(windows, names, "doc", "sub", "s", "least").where("least < doc")
    spans = hits.select("doc", "sub", (F.shiftleft(F.col("s").cast("long"), 32) + window).alias("span"))
    spans = spans.union(flags.select("doc", "sub", F.explode("covered").alias("span")))
    spans = stage(spans.groupBy("doc", "sub").agg(F.collect_list("span").alias("spans")), "spans")
    drop_staged(windows, names, flags)
    return keyed.join(spans, ["doc", "sub"], "left").select("doc_id", "text", "spans").mapInArrow(
        _remove(), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
