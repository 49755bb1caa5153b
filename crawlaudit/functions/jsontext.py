"""JSON texts as tokens: strict validity and members at any depth, without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

_STRING = r'"(?:[^"\\]|\\.)*+"'
_TOKEN = rf"{_STRING}|[{{}}\[\],:]|[^\s\"{{}}\[\],:]++"
_STRICT = r'^(?:"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"|[{}\[\],:]|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\z'


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _depth_change(t: Column) -> Column:
    return F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)


def is_valid(text: Column) -> Column:
    """One strictly written JSON value and nothing after it; a name may repeat."""

    def checked(ts: Column) -> Column:
        # Values that begin outside every bracket: exactly one.
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("roots"))
        step = lambda acc, t: F.struct(
            (acc["depth"] + _depth_change(t)).alias("depth"),
            (acc["roots"] + F.when((acc["depth"] == 0) & ~t.isin("}", "]"), 1).otherwise(0)).alias("roots"))
        end = F.aggregate(ts, start, step)
        return F.forall(ts, lambda t: t.rlike(_STRICT)) & (end["roots"] == 1) & (end["depth"] == 0)

    read = F.get_json_object(text, "$").isNotNull() | F.trim(text).isin("null", '""')
    return F.coalesce(read & let(tokens(text), checked), F.lit(False))


def compact(text: Column) -> Column:
    """The same JSON without white space between tokens."""
    return F.array_join(tokens(text), "")


def unquoted(token: Column) -> Column:
    """Value of a JSON string token."""
    return F.get_json_object(F.concat(F.lit('{"s":'), token, F.lit("}")), "$.s")


def quoted(value: Column) -> Column:
    """JSON string token of a value."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("s"))), r'(?s)^\{"s":(.*)\}\z', 1)
