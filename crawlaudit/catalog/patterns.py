"""The matcher of catalog patterns.

Every pattern names a literal token its text must hold. One alternation finds the
tokens of a signal, and only the patterns of those tokens run, each as a literal
compiled once: cost follows matches, not catalog size.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import DataFrame, functions as F


def token_regex(tokens) -> str:
    """Look-ahead alternation of literal tokens, grouped by first character.

    A zero-width match at every position finds overlapping tokens too, as long as
    no token starts another.
    """
    ordered = sorted(set(tokens))
    for a, b in zip(ordered, ordered[1:]):
        if b.startswith(a):
            raise ValueError(f"token {a!r} starts token {b!r}")
    branches = []
    for first, group in groupby(ordered, key=lambda t: t[0]):
        rest = "|".join(re.escape(t[1:]) for t in group)
        branches.append(f"{re.escape(first)}(?:{rest})")
    return f"(?=({'|'.join(branches)}))"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# What makes a match depend on the text around it, or on where the text ends.
_CONTEXT = re.compile(r"\(\?[=!<]|(?<!\\)(?:\\\\)*(?:\\[bBAzZ]|[$])|(?<![\[\\])\^")


def _hits(number: int, regex: str, groups: int) -> str:
    """SQL for the matches of one pattern in ``value``: its number, the position, the match and the group.

    The pattern is a literal, compiled once, and reads the text once; the group is taken from the match itself, except
    where the pattern looks at what stands around it.
    """
    row = lambda m, found: f"named_struct('k', {number}, 'match_pos', i, 'matched', {m}, 'found', {found})"
    whole = f"regexp_extract_all(value, {quoted(regex)}, 0)"
    if not groups:
        return f"transform({whole}, (m, i) -> {row('m', 'cast(null as string)')})"
    if not _CONTEXT.search(regex):
        return f"transform({whole}, (m, i) -> {row('m', f'nullif(regexp_extract(m, {quoted(regex)}, 1), "")')})"
    both = f"zip_with({whole}, regexp_extract_all(value, {quoted(regex)}, 1), (m, g) -> named_struct('m', m, 'g', nullif(g, '')))"
    return f"transform({both}, (z, i) -> {row('z.m', 'z.g')})"


def match(signals: DataFrame, patterns: list[dict], schema: str, outer: bool = False) -> DataFrame:
    """Signals (use, value, ...) joined to the patterns that match them; with ``outer``, signals without a match stay.

    Adds the pattern's columns, ``match_pos``, ``matched`` and ``found``: the captured group, or NULL for a pattern without
    one. One matcher finds all tokens of a signal; the patterns of a token found run as literals, inside the row. Matches
    fetch their pattern's columns by its number: the catalog has a fixed size, so that broadcast is bounded.
    """
    spark = signals.sparkSession
    none = "cast(null as array<struct<k:int,match_pos:int,matched:string,found:string>>)"
    cases = []
    for use in sorted({p["use"] for p in patterns}):
        of_token: dict[str, list[str]] = {}
        for number, p in enumerate(patterns):
            if p["use"] == use:
                of_token.setdefault(p["token"], []).append(_hits(number, p["regex"], p["groups"]))
        tokens = f"array_distinct(regexp_extract_all(lower(value), {quoted(token_regex(of_token))}, 1))"
        branches = " ".join(f"WHEN {quoted(t)} THEN concat({', '.join(hits)})" for t, hits in of_token.items())
        cases.append(f"WHEN {quoted(use)} THEN flatten(transform({tokens}, t -> CASE t {branches} ELSE {none} END))")
    hits = F.expr(f"CASE use {' '.join(cases)} END") if cases else F.expr(none)
    table = spark.createDataFrame([(i, *(p[c.strip().split()[0]] for c in schema.split(","))) for i, p in enumerate(patterns)], f"k int, {schema}")
    found = signals.select("*", (F.explode_outer if outer else F.explode)(hits).alias("_hit")).select(*signals.columns, "_hit.*")
    return found.join(F.broadcast(table.drop("use")), "k", "left" if outer else "inner").drop("k")


def match_parts(headers: DataFrame, patterns: list[dict]) -> DataFrame:
    """Headers (header, value, ...) joined to the patterns of their name that a part of them matches: (tech, pat_ord, found)."""
    of_name: dict[str, list[str]] = {}
    for p in patterns:
        part = f"get(filter(parts, p -> p rlike {quoted(p['regex'])}), 0)"
        found = f"nullif(regexp_extract(x, {quoted(p['regex'])}, 1), '')" if p["groups"] else "cast(null as string)"
        of_name.setdefault(p["header"], []).append(f"transform(array({part}), x -> if(x is null, null, named_struct('tech', {quoted(p['tech'])}, 'pat_ord', {p['pat_ord']}, 'found', {found})))")
    if not of_name:
        return headers.select("*", F.lit(None).cast("string").alias("tech"), F.lit(0).alias("pat_ord"), F.lit(None).cast("string").alias("found")).limit(0)
    branches = " ".join(f"WHEN {quoted(n)} THEN concat({', '.join(of)})" for n, of in of_name.items())
    parts = headers.where(F.col("header").isin(sorted(of_name))).withColumn("parts", F.transform(F.split("value", r",\s*"), lambda p: F.trim(p)))
    hits = F.expr(f"array_compact(CASE header {branches} END)")
    return parts.select(*headers.columns, F.explode(hits).alias("_hit")).select(*headers.columns, "_hit.*")


def group_count(regex: str) -> int:
    """Capturing groups of a pattern (0 or 1 in a catalog)."""
    n = re.compile(regex.replace(r"\z", r"\Z")).groups
    if n > 1:
        raise ValueError(f"more than one group: {regex}")
    return n
