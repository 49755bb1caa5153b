"""URL scalars as column expressions (U1-U3): normalise, resolve, split."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

_SPECIAL = r"(?i)^https?:"
_PARTS = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _encode(s: Column, extra: str) -> Column:
    """Percent-encode characters outside printable ASCII plus ``extra``."""
    keep = rf"[\x21-\x7e&&[^{extra}]]+"
    quote = lambda r: F.when(r.rlike(rf"^{keep}"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))

    def encode(x: Column) -> Column:
        runs = F.regexp_extract_all(x, F.lit(rf"{keep}|[^\x21-\x7e]+|[{extra}]+"), F.lit(0))
        return F.when(x.rlike(rf"[^\x21-\x7e]|[{extra}]"), F.array_join(F.transform(runs, quote), "")).otherwise(x)

    return let(s, encode)


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


# The parameters of Punycode.
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128


def _bias(delta: Column, size: Column, first: Column) -> Column:
    start = let(F.when(first, _div(delta, _DAMP)).otherwise(_div(delta, 2)), lambda d: d + _div(d, size))
    most = (_BASE - _TMIN) * _TMAX // 2
    step = lambda a, _: F.when(a["d"] > most, F.struct(_div(a["d"], _BASE - _TMIN).alias("d"), (a["k"] + _BASE).alias("k"))).otherwise(a)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(start.alias("d"), F.lit(0).cast("long").alias("k")), step)
    return let(end, lambda e: e["k"] + _div((_BASE - _TMIN + 1) * e["d"], e["d"] + _SKEW))


def _digits(delta: Column, bias: Column) -> Column:
    """A number as digits of growing weight; the first below its threshold is the last."""

    def step(a: Column, _: Column) -> Column:
        def put(t: Column) -> Column:
            last = a["q"] < t
            digit = F.when(last, a["q"]).otherwise(t + F.pmod(a["q"] - t, _BASE - t))
            return F.struct(F.when(last, 0).otherwise(_div(a["q"] - t, _BASE - t)).cast("long").alias("q"), (a["k"] + _BASE).alias("k"),
                            F.concat(a["out"], F.substring(F.lit(_DIGITS), digit.cast("int") + 1, F.lit(1))).alias("out"), last.alias("done"))

        return F.when(a["done"], a).otherwise(let(F.greatest(F.lit(_TMIN).cast("long"), F.least(F.lit(_TMAX).cast("long"), a["k"] - bias)), put))

    start = F.struct(delta.alias("q"), F.lit(_BASE).cast("long").alias("k"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)["out"]


def punycode(label: Column) -> Column:
    """ASCII form of a label (without its prefix).

    The characters outside ASCII are inserted in the order of their code points; each insertion is one number, made of the
    code point, the place, and the length so far, so all numbers are known before any is written.
    """

    def build(codes: Column) -> Column:
        basic = F.filter(codes, lambda c: c < _FIRST)
        placed = F.array_sort(F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("m"), i.alias("i"))), lambda e: e["m"] >= _FIRST))
        put = lambda e, k: F.struct(
            e["m"].cast("long").alias("m"), F.size(F.filter(codes, lambda c, j: (j < e["i"]) & (c <= e["m"]))).cast("long").alias("place"),
            (F.size(basic) + k + 1).cast("long").alias("size"))

        def write(steps: Column) -> Column:
            before = lambda k: F.get(steps, k - 1)
            deltas = F.transform(steps, lambda s, k: F.struct(
                F.when(k == 0, (s["m"] - _FIRST) * s["size"] + s["place"]).otherwise((s["m"] - before(k)["m"]) * s["size"] + s["place"] - before(k)["place"] - 1).alias("delta"),
                s["size"].alias("size"), (k == 0).alias("first")))
            add = lambda a, d: F.struct(F.concat(a["out"], _digits(d["delta"], a["bias"])).alias("out"), _bias(d["delta"], d["size"], d["first"]).alias("bias"))
            return F.aggregate(deltas, F.struct(F.lit("").alias("out"), F.lit(_BIAS).cast("long").alias("bias")), add)["out"]

        head = F.array_join(F.transform(basic, lambda c: F.char(c)), "")
        return F.concat(head, F.when(F.size(basic) > 0, "-").otherwise(""), let(F.transform(placed, put), write))

    return let(F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c)), build)


def ascii_host(host: Column) -> Column:
    """A host in lower case, labels outside ASCII in their ASCII form."""
    label = lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
    return let(F.lower(host), lambda h: F.when(h.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(h, "[.\u3002\uff0e\uff61]"), label), ".")).otherwise(h))


def _dot_segments(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments (plain or percent-encoded)."""
    one, two = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"

    def push(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(seg.rlike(two), up).when(seg.rlike(one), acc).otherwise(F.concat(acc, F.array(seg)))

    def remove(p: Column) -> Column:
        segs = F.split(p, "/")
        kept = F.aggregate(F.slice(segs, F.lit(2), F.size(segs)), F.array(F.lit("")), push)
        tail = F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(kept, tail), "/")

    return let(path, lambda p: F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), remove(p)).otherwise(p))


def normalize(url: Column) -> Column:
    """Serialised form of an absolute URL; unparsable input comes back as written.

    Only http(s) addresses are rewritten: scheme and host lower-cased, the default
    port dropped, an empty path made ``/``, dot segments removed, and characters
    outside ASCII percent-encoded. International host names take their ASCII form; backslashes count as slashes.
    """

    def build(m: Column) -> Column:
        scheme, path = m["scheme"], F.replace(m["path"], F.lit("\\"), F.lit("/"))
        port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
        host = F.when(F.endswith(m["host"], port), F.regexp_replace(m["host"], r":\d+$", "")).otherwise(m["host"])
        path = F.when(path == "", F.lit("/")).otherwise(_dot_segments(_encode(path, r'"<>`{}')))
        full = F.concat(
            scheme, F.lit("://"), F.regexp_replace(host, ":$", ""), path,
            _encode(m["query"], "\"<>'"), _encode(m["fragment"], '"<>`'),
        )
        return F.when((m["host"] == "") | m["host"].rlike(r"[\s<>^|%]"), m["url"]).otherwise(full)

    def split(u: Column) -> Column:
        part = lambda g: F.regexp_extract(u, _PARTS, g)
        fields = F.struct(
            u.alias("url"), F.lower(part(1)).alias("scheme"), ascii_host(part(2)).alias("host"),
            part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"),
        )
        return F.when(u.rlike(_SPECIAL), let(fields, build)).otherwise(u)

    return let(F.regexp_replace(strip(url), r"[\t\r\n]", ""), split)


def base_parts(base: Column) -> Column:
    """Pieces of an absolute page URL that resolution needs, computed once."""
    clean_url = F.regexp_replace(base, "#.*", "")
    return F.struct(
        F.regexp_extract(clean_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1).alias("scheme"),
        F.regexp_extract(clean_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1).alias("origin"),
        clean_url.alias("page"),
        F.regexp_replace(clean_url, r"\?.*", "").alias("path"),
        F.regexp_replace(F.regexp_replace(clean_url, r"\?.*", ""), r"[^/]*$", "").alias("dir"),
    )


def resolve(ref: Column, base: Column) -> Column:
    """Absolute form of ``ref`` against ``base`` (from ``base_parts``); NULL becomes '' (U1)."""

    def pick(r: Column) -> Column:
        joined = (
            F.when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), r)
            .when(r.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], r))
            .when(r.rlike(r"^[/\\]"), F.concat(base["origin"], r))
            .when(r == "", base["page"])
            .when(r.startswith("?"), F.concat(base["path"], r))
            .when(r.startswith("#"), F.concat(base["page"], r))
            .otherwise(F.concat(base["dir"], r))
        )
        return normalize(joined)

    return F.when(ref.isNull(), F.lit("")).otherwise(let(F.regexp_replace(strip(ref), r"[\t\r\n]", ""), pick))


def strip_hash(url: Column) -> Column:
    """URL without its fragment, serialised."""
    return F.coalesce(F.regexp_replace(normalize(url), "#.*", ""), F.lit(""))


def strip_hash_text(url: Column) -> Column:
    """Plain-string variant: everything before the first ``#``."""
    return F.regexp_replace(url, "#.*", "")


def host_of(url: Column) -> Column:
    """Host name without port, in lower case and ASCII form; NULL unless http(s)-like."""
    h = ascii_host(F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.-]*:[/\\]{2}(?:[^/\\?#@]*@)?([^/\\?#:]*)", 1))
    return F.when(h != "", h)


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def origin_of(url: Column) -> Column:
    """scheme://host[:port], lower-case."""
    o = F.regexp_extract(normalize(url), r"^(https?://[^/?#]+)", 1)
    return F.when(o != "", o)


def path_and_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(url), "#.*", ""), r"^https?://[^/?]+", "")


def bare_url(url: Column) -> Column:
    """Host and path without ``www.`` and trailing slash: the index key."""
    n = F.regexp_extract(normalize(url), r"^https?://([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(n, r"^www\.", ""), r"/$", "")


def is_serp(url: Column) -> Column:
    """Whether the address is a search results page."""
    host_ok = F.coalesce(host_of(url), F.lit("")).rlike(r"(?:^|\.)google\.(?:com|[a-z]{2}|co\.[a-z]{2}|com\.[a-z]{2})\z")
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host_ok & (path == "/search"), F.lit(False))
