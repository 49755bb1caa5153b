"""Robots directives and link headers as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, let, strip

# Directives that carry a colon and are never an agent scope.
VALUE_DIRECTIVES = ["unavailable_after", "max-snippet", "max-image-preview", "max-video-preview"]

_SCOPE = r"(?s)^([A-Za-z0-9_-]+)\s*:\s*(.*)$"


def parse_directives(value: Column) -> Column:
    """array<struct<agent, directive>> of a robots meta value or header (A2).

    A NULL agent means unscoped; a scope without directives keeps a NULL directive.
    """

    def token(t: Column) -> Column:
        agent = F.lower(F.regexp_extract(t, _SCOPE, 1))
        scoped = (agent != "") & ~agent.isin(VALUE_DIRECTIVES)
        rest = F.when(scoped, strip(F.regexp_extract(t, _SCOPE, 2))).otherwise(t)
        return F.struct(F.when(scoped, agent).alias("agent"), blank_to_null(F.lower(rest)).alias("directive"))

    tokens = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip), lambda t: t != "")
    parsed = F.transform(tokens, token)

    def spread(p: Column) -> Column:
        # The scope in force is the last one named so far.
        scope = lambda i: F.element_at(
            F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(F.slice(p, F.lit(1), i + 1), lambda x: x["agent"]), lambda a: a.isNotNull())), -1
        )
        rows = F.transform(
            p,
            lambda x, i: F.struct(
                scope(i).alias("agent"), x["directive"].alias("directive"), (x["agent"].isNotNull()).alias("opens"),
            ),
        )
        return F.filter(rows, lambda r: r["directive"].isNotNull() | r["opens"])

    return F.transform(let(parsed, spread), lambda r: F.struct(r["agent"].alias("agent"), r["directive"].alias("directive")))


def directives_for(value: Column, agent: str = "googlebot") -> Column:
    """Directives that apply to an agent: unscoped ones and its own (A3)."""
    own = F.filter(
        parse_directives(value), lambda r: (r["agent"].isNull() | (r["agent"] == agent)) & r["directive"].isNotNull()
    )
    return F.transform(own, lambda r: r["directive"])


def has_noindex(directives: Column) -> Column:
    return F.arrays_overlap(directives, F.array(F.lit("noindex"), F.lit("none")))


def has_nofollow(directives: Column) -> Column:
    return F.arrays_overlap(directives, F.array(F.lit("nofollow"), F.lit("none")))


def directives_chip(directives: Column) -> Column:
    """noindex / nofollow / index, follow (A4)."""
    chip = lambda d: F.when(has_noindex(d), "noindex").when(has_nofollow(d), "nofollow").otherwise("index, follow")
    return let(directives, chip)


def parse_link_header(value: Column) -> Column:
    """array<struct<url, rel, hreflang>> of a Link response header."""

    def param(part: Column, name: str) -> Column:
        pieces = F.split(F.regexp_extract(part, r"(?s)<[^>]*>(.*)", 1), ";")
        found = F.filter(pieces, lambda p: p.rlike(rf"""(?i)^\s*{name}\s*=\s*"?[^"]*"?\s*\z"""))
        last = F.try_element_at(found, F.lit(-1))
        return F.when(last.isNotNull(), F.regexp_extract(last, r"""(?i)^\s*[a-z-]+\s*=\s*"?([^"]*)"?\s*\z""", 1))

    parts = F.filter(F.split(value, r",(?=\s*<)"), lambda p: p.rlike(r"<[^>]*>"))
    rows = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"<([^>]*)>", 1).alias("url"),
            F.lower(F.coalesce(param(p, "rel"), F.lit(""))).alias("rel"),
            param(p, "hreflang").alias("hreflang"),
        ),
    )
    return F.coalesce(rows, F.array().cast("array<struct<url:string,rel:string,hreflang:string>>"))
