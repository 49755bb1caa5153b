"""Secret scans (operator 4): a worklist of decoded layers.

Every text is the first layer. A layer is searched for secrets, and for pieces that unwrap: percent escapes, Unicode
escapes and character references, base64 (of text or of a compressed stream). What a piece decodes to is a new layer, and
the worklist goes on until no layer gives a new one. A layer seen before in its chain ends it, so cycles stop. Each layer
knows for every one of its characters which span of the text it comes from, so what is found deep down is reported where
it stands in the text.

What a piece decodes to is read as UTF-8, else latin-1, and as UTF-16 or UTF-32 too if it has their mark or zero bytes.
Base64 that goes on over line breaks is joined, and compressed streams (zlib, gzip, bzip2, xz, lzma, zstd) are followed
member by member to what stands behind them; they may also be written as escaped bytes.

The search in the text itself is the base; layers only add spans. A task handles one document at a time, one layer after
the other. A compressed piece becomes layers of about ``LAYER_CHARS`` characters, each beginning ``OVERLAP`` characters
before the end of the one before, so no part stays unread. They are cut outside of base64 and escapes, unless one run is
longer than ``RUN_CHARS``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The kinds in their order, and the patterns of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ASSIGN_CHARS = 6
# A run that is long enough; shorter runs hold no match, so leaving them out of the pattern changes nothing.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

LAYER_CHARS = 4_000_000
OVERLAP = 100_000
RUN_CHARS = 16_000_000
FED = 1 << 16
LZMA_BYTES = 256 << 20

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\U[0-9A-Fa-f]{8})+|(?:\\x[0-9A-Fa-f]{2})+|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};")
# A run of either alphabet is searched whole: each has characters that end a run of the other.
BASE64 = re.compile(r"[A-Za-z0-9+/]{12,}={0,2}")
BASE64_URL = re.compile(r"[A-Za-z0-9_-]{12,}={0,2}")
BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
# Without one of these, a text has neither a span nor a further layer; without 12 characters neither.
HINT = re.compile(r"(?i:password|passwd|secret|token|api_?key)|[A-Za-z0-9+/_-]{12}|[A-Za-z0-9+/_-][ \t]*(?:[\r\n]|\\[rn])|%[0-9A-Fa-f]{2}|\\[uUx]|&\#")
LEAST_CHARS = 12
# Bytes as they are written in escapes, and where a stream may begin among them.
RAW = re.compile(ESCAPES.pattern + r"|\\[abfnrtv0\\'\"]")
RAW_CHARS = dict(zip("abfnrtv0\\'\"", "\a\b\f\n\r\t\v\0\\'\""))
ODD = re.compile(r"[^\t\r\n -~]")
STREAM = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x5d\x00\x00|\x28\xb5\x2f\xfd")
INSIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.%\\&#;\r\n\0"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contract's three kinds, leftmost and without overlap within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _decoded(run: str, raw: bool = False) -> list[tuple[str, int, int]] | None:
    """Characters of one escape run with the part of the run that each comes from; None if it does not decode.

    With ``raw``, escaped bytes stay bytes, one character each.
    """
    if len(run) == 2:
        return [(RAW_CHARS[run[1]], 0, 2)]
    if run[0] == "&":
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return [(chr(code), 0, len(run))] if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if run[0] == "%" or run[1] == "x":
        width = 3 if run[0] == "%" else 4
        data = bytes(int(run[i + width - 2 : i + width], 16) for i in range(0, len(run), width))
        try:
            text = data.decode("latin-1" if raw else "utf-8")
        except UnicodeDecodeError:
            text, raw = data.decode("latin-1"), True
        if raw:
            return [(c, i * width, (i + 1) * width) for i, c in enumerate(text)]
        out, at = [], 0
        for c in text:
            n = len(c.encode())
            out.append((c, at * width, (at + n) * width))
            at += n
        return out
    width = 6 if run[1] == "u" else 10
    codes = [int(run[i + 2 : i + width], 16) for i in range(0, len(run), width)]
    out, i = [], 0
    while i < len(codes):
        code, n = codes[i], 1
        if 0xD800 <= code < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000:
            code, n = 0x10000 + ((code - 0xD800) << 10) + codes[i + 1] - 0xDC00, 2
        if 0xD800 <= code < 0xE000 or code >= 0x110000:
            return None
        out.append((chr(code), i * width, (i + n) * width))
        i += n
    return out


Layer = tuple[str, np.ndarray, np.ndarray]  # text, and the start and end in the document of each character


def unescaped(layer: Layer, raw: bool = False) -> Layer | None:
    """The layer with its escapes replaced; None if there are none."""
    text, start, end = layer
    parts, starts, ends, at = [], [], [], 0
    for m in (RAW if raw else ESCAPES).finditer(text):
        chars = _decoded(m[0], raw)
        if chars is None:
            continue
        parts += [text[at : m.start()], "".join(c for c, _, _ in chars)]
        starts += [start[at : m.start()], np.array([start[m.start() + a] for _, a, _ in chars])]
        ends += [end[at : m.start()], np.array([end[m.start() + b - 1] for _, _, b in chars])]
        at = m.end()
    if not parts:
        return None
    return "".join(parts) + text[at:], np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]])


class _Zlib:
    """zlib and gzip with the manners of the other decompressors."""

    def __init__(self, window: int):
        self.tool, self.tail, self.needs_input = zlib.decompressobj(window), b"", True
        self.eof, self.unused_data = False, b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.tool.decompress(self.tail + data, most)
        self.tail, self.eof, self.unused_data = self.tool.unconsumed_tail, self.tool.eof, self.tool.unused_data
        self.needs_input = not self.tail and len(out) < most
        return out


def _tool(head: bytes):
    """What decompresses a stream that begins like this; None if nothing does."""
    if head[:2] == b"\x1f\x8b":
        return _Zlib(31)
    if len(head) > 2 and head[0] & 15 == 8 and head[0] < 128 and (head[0] * 256 + head[1]) % 31 == 0 and not head[1] & 32:
        return _Zlib(15)
    if head[:3] == b"BZh" and head[4:10] in (b"1AY&SY", b"\x17\x72\x45\x38\x50\x90"):
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0" or head[:3] == b"\x5d\0\0":
        return lzma.LZMADecompressor(memlimit=LZMA_BYTES)
    return None


def _zstd_end(data: memoryview, at: int) -> int:
    """Where the zstd frame at ``at`` ends; the end of the data if it breaks off."""
    import zstandard

    to = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while to + 3 <= len(data):
        head = int.from_bytes(data[to : to + 3], "little")
        to += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return min(to + (4 if data[at + 4] & 4 else 0), len(data))
    return len(data)


def _chunks(data: memoryview, used: list[int]) -> Iterator[bytes]:
    """What the compressed streams at the start of the data hold, one after another; ``used`` gets the bytes read."""
    at = 0
    try:
        while True:
            head = bytes(data[at : at + 18])
            if head[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                to = _zstd_end(data, at)
                source = zstandard.ZstdDecompressor().stream_reader(data[at:to])
                used[0] = to
                while part := source.read(LAYER_CHARS // 4):
                    yield part
            elif at and head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
                to = min(at + 8 + int.from_bytes(head[4:8], "little"), len(data))
            elif (tool := _tool(head)) is not None:
                to = at
                while not tool.eof:
                    more = bytes(data[to : to + FED]) if tool.needs_input else b""
                    to += len(more)
                    used[0] = to
                    part = tool.decompress(more, LAYER_CHARS // 4)
                    if part:
                        yield part
                    elif not more and not tool.eof:
                        return
                to -= len(tool.unused_data)
            else:
                return
            used[0] = at = to
            # Members may be padded with zeros.
            while at < len(data) and data[at] == 0:
                at += 1
    except Exception:  # a stream that breaks off is searched as far as it goes
        return


def _parts(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks in parts of bounded size that overlap, cut where no piece that could be unwrapped goes on."""
    held, passed, fresh, look = bytearray(), 0, 0, LAYER_CHARS
    for chunk in chunks:
        held += chunk
        if len(held) < look:
            continue
        run = len(held.rstrip(INSIDE))
        cut, step = run, passed
        if run <= fresh or run < len(held) - RUN_CHARS:
            if len(held) - run < RUN_CHARS:
                look = len(held) + LAYER_CHARS // 4
                continue
            cut, step = run + (len(held) - run) // 4 * 4, -run
        yield bytes(held[:cut])
        keep = max(0, cut - OVERLAP)
        keep -= (keep + step) % 4
        keep = max(keep, 0)
        del held[:keep]
        passed, fresh = passed + keep, cut - keep
        look = max(LAYER_CHARS, len(held) + LAYER_CHARS // 4)
    if len(held) > fresh:
        yield bytes(held)


def _readings(data: bytes) -> Iterator[tuple[str, np.ndarray | None]]:
    """The texts that bytes may be, with the bytes that each character takes; None is one each."""
    try:
        text = data.decode()
        yield text, None if len(text) == len(data) else np.array([len(c.encode()) for c in text])
    except UnicodeDecodeError:
        yield data.decode("latin-1"), None
    mark = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    if not mark and b"\0" not in data:
        return
    zeros = np.frombuffer(data, np.uint8) == 0
    little = data[:2] == b"\xff\xfe" if mark else zeros[1::2].sum() >= zeros[::2].sum()
    if zeros.sum() * 2 > len(data):
        little = data[:2] == b"\xff\xfe" or data[:4] != b"\0\0\xfe\xff" and zeros[3::4].sum() >= zeros[::4].sum()
        codes = np.frombuffer(data[: len(data) // 4 * 4], "<u4" if little else ">u4").tolist()
        yield "".join(chr(c) if c < 0x110000 else "\ufffd" for c in codes), np.full(len(codes), 4)
    else:
        even = data[: len(data) // 2 * 2]
        try:
            text = even.decode("utf-16-le" if little else "utf-16-be", "surrogatepass")
        except UnicodeDecodeError:  # a surrogate is cut off at the end
            text = "".join(map(chr, np.frombuffer(even, "<u2" if little else ">u2").tolist()))
        yield text, np.array([4 if c > "\uffff" else 2 for c in text], np.int64)


def _worth(text: str) -> bool:
    return len(text) >= LEAST_CHARS and HINT.search(text) is not None


def _inflated(data: memoryview, a: int, b: int) -> Iterator[Layer]:
    """Layers of what compressed streams hold; all of it comes from the whole piece."""
    for part in _parts(_chunks(data, [0])):
        for text, _ in _readings(part):
            if _worth(text):
                yield text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text))


def _taken(data: memoryview) -> int:
    """Bytes that the streams at the start of the data take; none if nothing comes out of them."""
    used, some = [0], False
    for _ in _chunks(data, used):
        some = True
    return used[0] if some else 0


def _joined(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines (from, to) of base64 that goes on over line breaks, in every way they may belong together.

    Lines of one length and a shorter last one are a piece, also with the line before, which may be a first line that
    began late; and so is the whole.
    """
    for m in WRAPPED.finditer(text):
        breaks = [b.span() for b in BREAK.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]))
        size = [b - a - text.count("=", a, b) for a, b in lines]
        ways, i = {(0, len(lines))}, 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and size[j] == size[i]:
                j += 1
            to = j + (j < len(lines) and size[j] < size[i])
            ways.add((i, to))
            if i and j - i > 1:
                ways.add((i - 1, to))
            i = j
        for i, j in sorted(ways, key=lambda w: (w[0], -w[1])):
            if j - i > 1 and sum(size[i:j]) >= 12:
                yield lines[i:j]


def unpacked(layer: Layer) -> Iterator[Layer]:
    """Layers inside the layer's base64 pieces."""
    text, start, end = layer
    # Of two runs from one place the shorter decodes to a part of what the longer does.
    runs: dict[int, int] = {}
    for pattern in (BASE64, BASE64_URL):
        for m in pattern.finditer(text):
            runs[m.start()] = max(m.end(), runs.get(m.start(), 0))
    begun: set[int] = set()
    outer, read = (0, 0), (0, 0)
    for lines in itertools.chain(_joined(text), ([run] for run in sorted(runs.items()))):
        at, to = lines[0][0], lines[-1][1]
        body = "".join(text[a:b] for a, b in lines).rstrip("=")
        body = body[: len(body) - (len(body) % 4 == 1)]
        if body.isdecimal():
            continue
        try:
            data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        packed = data[:4] == b"\x28\xb5\x2f\xfd" or _tool(data[:18]) is not None
        if len(lines) == 1:
            # Inside of a stream's run, or in step with the run around it, a run shows nothing else.
            if to <= read[1] or to <= outer[1] and (at - outer[0]) % 4 == 0 and not packed:
                continue
            outer = (at, to) if to > outer[1] else outer
        if packed:
            if at in begun:
                continue
            used = _taken(memoryview(data)) if len(lines) > 1 else len(data)
            if used:
                begun.add(at)
                place = lambda i: next(a + i - n for (a, b), n in zip(lines, itertools.accumulate((b - a for a, b in lines), initial=0)) if i < n + b - a)
                last = place(min((used * 4 + 2) // 3, len(body)) - 1)
                yield from _inflated(memoryview(data), start[at], end[last])
                # What stands behind the streams is read like any other piece.
                rest = used if len(lines) > 1 else _taken(memoryview(data))
                if rest:
                    read = (at, at + rest * 4 // 3) if len(lines) == 1 else read
                    data = b"\xff" * rest + data[rest:]
        for inner, sizes in _readings(data):
            if not _worth(inner):
                continue
            if start.strides == (0,):
                yield inner, np.broadcast_to(start[at], len(inner)), np.broadcast_to(end[at], len(inner))
                continue
            # Byte i comes from the characters i * 4 / 3 and the next; a character's bytes lie side by side.
            sizes = np.ones(len(inner), np.int64) if sizes is None else sizes
            upto = np.cumsum(sizes)
            first, last = (upto - sizes) * 4 // 3, np.minimum((upto * 4 + 2) // 3, len(body)) - 1
            place = np.concatenate([np.arange(a, b) for a, b in lines])
            yield inner, start[place[first]], end[place[last]]


def unescaped_streams(layer: Layer) -> Iterator[Layer]:
    """Layers inside compressed streams whose bytes are written as escapes."""
    raw = unescaped(layer, True)
    if raw is None:
        return
    text, start, end = raw
    data, done = memoryview(text.encode("latin-1", "replace")), 0
    for m in STREAM.finditer(data):
        if m.start() >= done and (used := _taken(data[m.start() :])):
            done = m.start() + used
            yield from _inflated(data[m.start() : done], start[m.start()], end[done - 1])


# An opener behind which one unit comes again and again: each level of unescaping takes one unit away and leaves the rest.
DEEP = re.compile(r"(?:%(25)|&(\#[0-9]{1,7};|\#[xX][0-9A-Fa-f]{1,6};)|\\(x5[cC]|u005[cC]|U0000005[cC]))(?:\1|\2|\3){7,}+")
# Levels read as they are before and after the levels that a jump passes: every place of a base64 run in its group of four.
STEADY = 4
_HEX_RUN = re.compile("[0-9a-f]*")


def _deep_runs(text: str) -> list[tuple[int, int, int]] | None:
    """(opener, length of the unit, units) of every deep run, if the text has no other escape; else None."""
    runs = []
    for m in ESCAPES.finditer(text):
        deep = DEEP.match(text, m.start())
        unit = deep and next(u for u in deep.groups() if u)
        # The first escape has to give the opener back, and to stand alone.
        if not deep or m.end() != m.start() + 1 + len(unit) or _decoded(m[0]) != [(text[m.start()], 0, len(m[0]))]:
            if _decoded(m[0]) is None:
                continue
            return None
        runs.append((m.start(), len(unit), (len(deep[0]) - 1) // len(unit)))
    return runs or None


def _jumped(layer: Layer, runs: list[tuple[int, int, int]], found: set) -> Layer:
    """The layer so many levels on that its shortest deep run has STEADY units left; ``found`` gets what the levels between show.

    Between, only units go. They show hexadecimal runs that begin at a later unit each time, and nothing else: what a base64
    run decodes to is the end of what it decoded to some levels before.
    """
    text, start, end = layer
    levels = min(units for _, _, units in runs) - STEADY
    parts, starts, ends, at = [], [], [], 0
    for opener, size, units in runs:
        if text[opener] == "%":
            stop = _HEX_RUN.match(text, opener + 1).end()
            found.update((int(start[opener + 1 + k * size]), int(end[stop - 1]), "hex") for k in range(1, levels) if stop - opener - 1 - k * size >= 24)
        after = opener + 1 + levels * size
        parts += [text[at : opener + 1]]
        starts.append(start[at : opener + 1])
        ends += [end[at:opener], end[after - 1 : after]]
        at = after
    return "".join(parts) + text[at:], np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]])


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text: its own, and those of every layer that unwraps from it."""
    found = set(base_spans(text))
    if not any(p.search(text) for p in (ESCAPES, BASE64, BASE64_URL, WRAPPED)):
        return _ordered(found)
    n = np.arange(len(text))
    done: set[tuple] = set()
    above: set[bytes] = set()  # the layers between the text and the one that is read

    def below(layer: Layer | None, outermost: bool = False) -> Iterator[Layer]:
        """Searches a layer and what its escapes leave, level after level, and gives the layers inside each.

        A level is given up before the next is made, so a chain of escapes holds one layer, however long it is.
        """
        marks, steady = [], 0
        while layer is not None and layer[0]:
            mark = hashlib.blake2b(layer[0].encode("utf-8", "surrogatepass"), digest_size=16).digest()
            # The same text from the same place was searched before, whatever the way to it.
            at = (mark, int(layer[1][0]), int(layer[2][-1]))
            if mark in above or at in done:
                break
            done.add(at)
            above.add(mark)
            marks.append(mark)
            if not outermost:
                found.update((int(layer[1][a]), int(layer[2][b - 1]), kind) for a, b, kind in base_spans(layer[0]))
            outermost = False
            plain = unescaped(layer)
            if plain is not None and ODD.search(plain[0]):
                yield from unescaped_streams(layer)
            yield from unpacked(layer)
            runs = None if plain is None else _deep_runs(layer[0])
            steady = steady + 1 if runs else 0
            layer, plain = (plain, None) if steady <= STEADY else (_jumped(layer, runs, found), None)
            steady = min(steady, STEADY)
        above.difference_update(marks)

    work = [below((text, n, n + 1), True)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        else:
            work.append(below(inner))
    return _ordered(found)


def _ordered(found) -> list[tuple[int, int, str]]:
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; null text is the empty text.

    The counts and base_sha256 are of the text's own spans, ``spans`` lists those of all layers. Repeated rows give
    repeated rows, an empty table gives none, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                base = _ordered(base_spans(text or ""))
                for of, kind in zip(counts, KINDS):
                    of.append(sum(f[2] == kind for f in base))
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append(_said(scan(text or "")))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
