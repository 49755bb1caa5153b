"""Packing documents into training sequences (operator 5): non-negative least squares on the length histogram.

A block of documents is tokenised and cut: every whole window of a document becomes a sequence, and what is left over
is an item shorter than the window. The items' length histogram is covered by combinations of one to ``DEPTH`` lengths
that fill a window exactly; their repeat counts are the non-negative least squares solution, rounded down. Items that no
rounded combination takes are packed greedily, longest first, the open sequence being filled by cutting.

A task works on its own partition in blocks of a bounded number of tokens, so nothing is shuffled, no histogram is
gathered, and a lost executor only repeats its tasks. The open sequence passes from block to block; the partition's last
one is cut into powers of two, which need no padding.

Null text is the empty text: one token, the end mark. Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 2048
END_ID = 1
DEPTH = 3
BLOCK_TOKENS = 4_000_000
CACHE_ENTRIES = 400_000
COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def public_path(name: str) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    A blank between two characters that are not white space always starts a new pre-token of this vocabulary's pattern,
    so such texts are cut there and the ids of each part are looked up; the table is emptied when it is full. Other
    texts are encoded whole. Texts that hold a special token's string go to the reference tokenizer.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str | None = None):
        path = path or public_path("byte_bpe_50k.json")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = self._ranks(os.path.splitext(path)[0] + ".tiktoken")
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary as ranks, several times faster; None where that file is missing."""
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        if self.fast is None or self.SPECIAL in text:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.SPECIAL in text:
            return self._whole(text)
        known, parts = self.known, text.split(" ")
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = [known.get(part) for part in parts]
        out[0] = self._whole(parts[0])
        if None in out:
            for at, ids in enumerate(out):
                if ids is None:
                    part = parts[at]
                    if not part or part[0].isspace() or part[-1].isspace():
                        return self._whole(text)
                    out[at] = known[part] = known.get(part) or self._whole(" " + part)
        return b"".join(out)


def combinations(lengths: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` non-decreasing lengths out of ``lengths`` that fill the window; unused places are 0."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = [np.stack([a := lengths[lengths == window]] + [np.zeros_like(a)] * (depth - 1), 1)]
    if depth >= 2:
        a = lengths[lengths <= window // 2]
        b = window - a
        ok = have[b] & (b >= a)
        found.append(np.stack([a[ok], b[ok]] + [np.zeros(int(ok.sum()), a.dtype)] * (depth - 2), 1))
    if depth >= 3:
        a, b = (x.ravel() for x in np.meshgrid(lengths[lengths <= window // 3], lengths[lengths <= window // 2], indexing="ij"))
        c = window - a - b
        ok = (a <= b) & (b <= c)
        a, b, c = a[ok], b[ok], c[ok]
        ok = have[c]
        found.append(np.stack([a[ok], b[ok], c[ok]] + [np.zeros(int(ok.sum()), a.dtype)] * (depth - 3), 1))
    return np.concatenate(found)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that least squares fits to the histogram.

    Multiplicative updates x <- x * (A'h) / (A'Ax): they keep x non-negative and never raise the squared error. A column
    of A has one entry for each place of its combination, so both products are gathers and one bincount.
    """
    used = combos > 0
    gather = lambda v: np.where(used, v[combos], 0.0).sum(1)
    x, target = np.full(len(combos), 1.0), gather(histogram.astype(float))
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]) * used.ravel(), minlength=len(histogram))
        x *= target / np.maximum(gather(made), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) after rounding; together they take no more items of a length than there are."""
    combos = combinations(np.nonzero(histogram)[0], window, depth)
    if not len(combos):
        return []
    x = solve_counts(combos, histogram)
    left, out = histogram.copy(), []

    def take(counts: np.ndarray, order: np.ndarray) -> None:
        """Take combinations in this order, each as often as it is wanted and items are left."""
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            part = part[((left[combos[part]] > 0) | (combos[part] == 0)).all(1)]
            for i, combo in zip(part.tolist(), combos[part].tolist()):
                combo = tuple(v for v in combo if v)
                n = min(int(counts[i]), *(int(left[v]) // combo.count(v) for v in combo))
                if n > 0:
                    for v in combo:
                        left[v] -= n
                    out.append((combo, n))

    # Whole counts first, then one more of each by the size of the fraction.
    whole = np.floor(x + 1e-9)
    take(whole, (order := np.argsort(-x, kind="stable"))[whole[order] >= 1])
    take(np.ones(len(x)), np.argsort(whole - x, kind="stable"))
    return out


class Packer:
    """Pieces of one partition."""

    def __init__(self, partition: int, window: int = WINDOW, depth: int = DEPTH):
        self.window, self.depth = window, depth
        self.next = partition << 40
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # pieces of the open sequence: (doc_id, start, ids, doc_tokens)
        self.fill = 0

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def _greedy(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        while ids:
            n = min(len(ids) // 4, self.window - self.fill)
            self.open.append((doc_id, start, ids[: 4 * n], total))
            self.fill, start, ids = self.fill + n, start + n, ids[4 * n :]
            if self.fill == self.window:
                self._close(self.open)
                self.open, self.fill = [], 0

    def block(self, docs: list[tuple[int, bytes]]) -> list[tuple]:
        """Pack one block of (doc_id, ids); returns the finished pieces."""
        whole = 4 * self.window
        items: dict[int, list[tuple]] = {}
        for doc_id, ids in docs:
            total, cut = len(ids) // 4, len(ids) - len(ids) % whole
            for at in range(0, cut, whole):
                self._close([(doc_id, at // 4, ids[at : at + whole], total)])
            if cut < len(ids):
                items.setdefault((len(ids) - cut) // 4, []).append((doc_id, cut // 4, ids[cut:], total))
        histogram = np.zeros(self.window + 1, np.int64)
        for length, of in items.items():
            histogram[length] = len(of)
        for combo, n in plan(histogram, self.window, self.depth):
            for _ in range(n):
                self._close([items[length].pop() for length in combo])
        for length in sorted(items, reverse=True):
            for piece in items[length]:
                self._greedy(piece)
        return self._take()

    def end(self) -> list[tuple]:
        """Cut the open sequence into powers of two."""
        pieces, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            take: list[tuple] = []
            while room:
                doc_id, start, ids, total = pieces[0]
                n = min(len(ids) // 4, room)
                take.append((doc_id, start, ids[: 4 * n], total))
                room -= n
                pieces = pieces[1:] if 4 * n == len(ids) else [(doc_id, start + n, ids[4 * n :], total), *pieces[1:]]
            self._close(take)
        return self._take()

    def _take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, depth: int = DEPTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document: where it starts, its ids' checksum, its sequence and its place there.

    ``tokenizer`` is the path of the vocabulary file on the executors, the installed one by default. ``block_tokens``
    bounds what a task holds: a block ends after the document that reaches it.
    """
    names = [f.split()[0] for f in COLUMNS.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, docs_, held = None, None, [], 0
        end = np.array([END_ID], "<u4").tobytes()
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                encode, packer = Encoder(tokenizer), Packer(batch.column(2)[0].as_py(), window, depth)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                docs_.append((doc_id, ids))
                held += len(ids) // 4
                if held >= block_tokens:
                    if rows := packer.block(docs_):
                        yield table(rows)
                    docs_, held = [], 0
        if packer is not None:
            if rows := packer.block(docs_) + packer.end():
                yield table(rows)

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, COLUMNS)
