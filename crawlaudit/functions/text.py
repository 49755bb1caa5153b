"""Text scalars: whitespace, entities, lengths, clipping and phrases."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# Unicode white space plus the byte-order mark, in Java regex syntax.
WS = r"(?U)[\s\x{FEFF}]"

# Accepted length ranges in code points.
TITLE_RANGE = (30, 60)
DESCRIPTION_RANGE = (70, 160)

# Named references by first letter, and those that need no semicolon; the table is the standard library's.
_NAMED: dict[str, dict[str, str]] = {}
for _name, _text in sorted(html5.items(), key=lambda x: (len(x[0]), x[0])):
    if _name.endswith(";"):
        _NAMED.setdefault(_name[0], {})[_name[:-1]] = _text
_SHORT = {name: text for name, text in html5.items() if not name.endswith(";")}
_SHORT_LENGTHS = sorted({len(name) for name in _SHORT}, reverse=True)
# Code points that pages mean as Windows-1252.
_WESTERN = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (usable inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(s: Column) -> Column:
    """Collapse white space to single spaces and trim; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), WS + "+", " "))


def strip(s: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(s, rf"^{WS}+|{WS}+\z", "")


def blank_to_null(s: Column) -> Column:
    return F.when(s != "", s)


def _code_point(n: Column) -> Column:
    ok = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    western = F.substring(F.lit("".join(_WESTERN)), (n - 127).cast("int"), F.lit(1))
    return F.when(n.between(128, 159), western).when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def _table(entries) -> Column:
    kind = "map<string,map<string,string>>" if isinstance(next(iter(entries.values())), dict) else "map<string,string>"
    return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False)), kind)


def _entity(part: Column, attribute: bool) -> Column:
    """``part`` is the text after an ampersand.

    A name with its semicolon is looked up whole; of any other the longest beginning that needs none counts, in an attribute
    only if neither a letter, a digit nor an equals sign follows it.
    """
    start = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*)"

    def numeric(ref: Column) -> Column:
        value = F.when(ref.rlike("^#[xX]"), _code_point(F.conv(F.substring(ref, 3, 6), 16, 10).cast("long"))).otherwise(_code_point(F.substring(ref, 2, 7).try_cast("long")))
        return F.concat(value, F.regexp_replace(part, r"^#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", ""))

    def short(ref: Column) -> Column:
        found = F.lit(None).cast("string")
        for n in sorted(_SHORT_LENGTHS):
            rest = F.substring(part, n + 1, F.length(part))
            fits = (F.length(ref) >= n) & (~rest.rlike("^[A-Za-z0-9=]") if attribute else F.lit(True))
            of = {k: v for k, v in _SHORT.items() if len(k) == n}
            found = F.coalesce(F.when(fits, F.concat(_table(of)[F.left(ref, F.lit(n))], rest)), found)
        return found

    def expand(ref: Column) -> Column:
        closed = F.substring(part, F.length(ref) + 1, F.lit(1)) == ";"
        named = F.when(closed, F.concat(_table(_NAMED)[F.left(ref, F.lit(1))][ref], F.substring(part, F.length(ref) + 2, F.length(part))))
        value = F.when(ref == "", None).when(ref.startswith("#"), numeric(ref)).otherwise(F.coalesce(named, short(ref)))
        return F.coalesce(value, F.concat(F.lit("&"), part))

    return let(F.regexp_extract(part, start, 1), expand)


def decode_entities(s: Column, attribute: bool = False) -> Column:
    """Decode character references, numeric and named, as in text or as in an attribute's value."""

    def expand(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: _entity(p, attribute))
        return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))

    return let(s, lambda x: F.when(x.contains("&"), let(F.split(x, "&"), expand)).otherwise(x))


def length_status(s: Column, limits: tuple[int, int]) -> Column:
    """missing / short / good / long by code-point count."""
    n = F.length(s)
    return (
        F.when(s.isNull() | (s == ""), "missing")
        .when(n < limits[0], "short")
        .when(n > limits[1], "long")
        .otherwise("good")
    )


def clip(s: Column, n: int = 90) -> Column:
    """Cleaned text of at most ``n`` characters, ellipsis included."""
    cut = lambda t: F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 1)), F.lit("…"))).otherwise(t)
    return let(clean(s), cut)


def short_url(url: Column) -> Column:
    """Path and query of a URL, shortened from the left to 80 characters."""
    path = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://[^/?#]*", ""), "#.*", "")
    s = F.when(url.rlike(r"(?i)^https?://[^/?#]"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))).otherwise(url)
    return F.when(F.length(s) > 80, F.concat(F.lit("…"), F.right(s, F.lit(79)))).otherwise(s)


def exact_phrase(s: Column, max_words: int | None = 32) -> Column:
    """Quote-free phrase of at most ``max_words`` words, the limit of a search box; None keeps all."""
    # The six double-quote characters.
    words = clean(F.regexp_replace(s, "[\"“”„«»]", " "))
    return words if max_words is None else F.array_join(F.slice(F.split(words, " "), 1, max_words), " ")


def file_name(src: Column) -> Column:
    """Readable name of an image address (U8)."""
    host = F.regexp_extract(src, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(src, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1)
    # Form decoding would turn "+" into a space; a path keeps it.
    decoded = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    return (
        F.when(src.isNull() | (src == ""), "(no src)")
        .when(src.startswith("data:"), "Inline data URI")
        .when(host == "", src)
        .when(last.isNull(), host)
        .otherwise(F.coalesce(decoded, src))
    )


# Reason phrases shown for HTTP status codes.
STATUS_TEXT = {
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative", 204: "No Content",
    206: "Partial Content", 301: "Moved Permanently", 302: "Found", 303: "See Other",
    304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request",
    401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 410: "Gone",
    429: "Too Many Requests", 451: "Unavailable For Legal Reasons", 500: "Internal Server Error",
    502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def status_text(code: Column) -> Column:
    """Reason phrase of an HTTP status, '' when not listed."""
    table = F.from_json(F.lit(json.dumps({str(k): v for k, v in STATUS_TEXT.items()})), "map<string,string>")
    return F.coalesce(table[code.cast("string")], F.lit(""))


def status_class(code: Column) -> Column:
    """good below 300, warn below 400, else bad."""
    return F.when(code < 300, "good").when(code < 400, "warn").when(code.isNotNull(), "bad")
