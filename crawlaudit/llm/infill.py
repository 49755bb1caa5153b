"""Fill-in-middle transformation (operator 13) by piece tables.

A document is never copied while it is rearranged. It becomes a table of descriptors (buffer, from, to) over two immutable
buffers: its own bytes and the sentinels. Cutting splits a descriptor in two, an arrangement permutes descriptors and puts
sentinel descriptors between them, the inverse permutation restores the document, and a hash streams over descriptors. Text is
written once, when the output is.

Documents need nothing of each other, so Spark deals rows to tasks as the table lies: no shuffle. A task holds one document
and its output at a time, and hands results on in parts of about ``PART_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The sentinels, and where each begins in their buffer.
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (0, 3), (3, 6), (6, 9)
TEXT, MARKS = 0, 1
# An arrangement: for every sentinel the piece of the document (0 prefix, 1 middle, 2 suffix) that follows it.
ARRANGEMENTS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
TRANSFORMED, SPM = 90, 20
PART_BYTES = 16 << 20

Piece = tuple[int, int, int]  # buffer, from, to


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same pieces with a boundary ``at`` bytes after their start; a boundary at an end gives an empty piece."""
    out: list[Piece] = []
    for n, (buffer, a, b) in enumerate(pieces):
        if at <= b - a:
            return [*out, (buffer, a, a + at), (buffer, a + at, b), *pieces[n + 1 :]]
        out.append((buffer, a, b))
        at -= b - a
    raise IndexError("cut behind the last piece")


def arrange(pieces: Sequence[Piece], form: str) -> list[Piece]:
    """Three pieces in the order of a form, each behind its sentinel."""
    return [p for mark, of in ARRANGEMENTS[form] for p in ((MARKS, *mark), pieces[of])]


def stream(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> Iterator[memoryview]:
    for buffer, a, b in pieces:
        if b > a:
            yield buffers[buffer][a:b]


def digest(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> str:
    h = hashlib.sha256()
    for part in stream(pieces, buffers):
        h.update(part)
    return h.hexdigest()


def restore(output: bytes, form: str) -> list[Piece]:
    """Pieces of the document over an output's bytes, known by its form alone.

    A transformed document holds no sentinel and none arises at a seam, so the first one found is the one put there.
    """
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order = ARRANGEMENTS[form]
    starts, at = [], 0
    for (a, b), _ in order:
        at = output.index(SENTINELS[a:b], at)
        starts.append((at, at + b - a))
        at += b - a
    ends = [*(a for a, _ in starts[1:]), len(output)]
    place = {of: (TEXT, begin, end) for (_, of), (_, begin), end in zip(order, starts, ends)}
    return [place[i] for i in range(len(place))]


def draws(doc_id: int | None) -> list[int]:
    """The four draws of a document; a null id has the draws of an empty one."""
    named = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(named[i : i + 8], 16) for i in range(0, 32, 8)]


def chars_at(data: bytes) -> np.ndarray:
    """Where each code point of UTF-8 begins; no array of numbers is made for plain ASCII."""
    return np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)


def transform(doc_id: int | None, data: bytes) -> tuple[int, str, list[Piece], int | None, int | None]:
    """(code points, form, pieces of the output, prefix and middle in code points) of a document's UTF-8 bytes."""
    ascii_ = data.isascii()
    begins = None if ascii_ else chars_at(data)
    n = len(data) if ascii_ else len(begins)
    h1, h2, h3, h4 = draws(doc_id)
    whole = [(TEXT, 0, len(data))]
    if not data or h3 % 100 >= TRANSFORMED or any(SENTINELS[a:b] in data for a, b in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", whole, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    byte = lambda k: k if ascii_ else (int(begins[k]) if k < n else len(data))
    pieces = cut(cut(whole, byte(second)), byte(first))
    form = "spm" if h4 % 100 < SPM else "psm"
    return n, form, arrange(pieces, form), first, second - first


SCHEMA = """doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string,
    pieces array<struct<buffer:int,from:long,to:long>>, output string"""
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("from", pa.int64()), ("to", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _PIECES, pa.binary()]
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "pieces", "output"]


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, pieces, output.

    ``pieces`` is the output's piece table (buffer 0 is the text's bytes, 1 the sentinels), ``output`` its text, and
    ``restored_sha256`` the hash of what :func:`restore` makes of output and form. Null text is the empty text, which stays plain.
    A null doc_id draws like an empty one. Repeated rows give repeated rows, an empty table gives none, other columns are
    not read.
    """
    marks = memoryview(SENTINELS)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
        columns[-1] = columns[-1].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = text.as_py() or b""
                n, form, pieces, prefix, middle = transform(doc_id, data)
                buffers = [memoryview(data), marks]
                output = data if form == "plain" else b"".join(stream(pieces, buffers))
                rows.append((
                    doc_id, n, form, prefix, middle, digest(pieces, buffers), digest(restore(output, form), [memoryview(output)]),
                    [{"buffer": x, "from": a, "to": b} for x, a, b in pieces], output,
                ))
                held += len(output)
                if held >= PART_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
