"""Markup scalars: masking, tag extraction, attributes and text.

A page is one row, so every pattern here runs inside the row: extraction never
shuffles, whatever the size of the crawl or of one host.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import clean, decode_entities, let

# One attribute of a start tag, then the rest of the tag. Possessive throughout:
# no backtracking and no recursion on long values.
_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_ATTR = rf"""[\s/]*+[^\s/>][^\s/>=]*+{_VALUE}"""
REST = rf"(?:{_ATTR})*+[\s/]*+>"
_END = r"(?=[\s/>])"

# Elements whose content is text, not markup (scripting on).
_RAW = "script|style|noscript|template|iframe|noembed|noframes|xmp|textarea|title"
_RAW_PATTERN = rf"(?is)<!--.*?(?:-->|\z)|(<({_RAW}){_END}{REST}).*?(</\2{_END}[^>]*+>|\z)"

# Elements that break a line in rendered text.
_BLOCK = (
    "address|article|aside|blockquote|body|br|button|caption|dd|details|dialog|div|dl|dt|fieldset|figcaption|"
    "figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|select|"
    "summary|table|tbody|td|tfoot|th|thead|tr|ul"
)


def raw_parts(html: Column) -> Column:
    """Comments and raw-text elements of a page, whole, in document order."""
    return F.regexp_extract_all(html, F.lit(_RAW_PATTERN), F.lit(0))


def masked(html: Column) -> Column:
    """The page without comments and with raw-text elements emptied."""
    return F.regexp_replace(html, _RAW_PATTERN, "$1$3")


def without_svg(html: Column) -> Column:
    cut = F.regexp_replace(html, rf"(?is)<svg{_END}.*?</svg\s*+>", "")
    return F.when(html.rlike(r"(?i)<svg[\s>]"), cut).otherwise(html)


def start_tags(doc: Column, names: str = r"[a-z][^\s/>]*+") -> Column:
    """Start tags with the given names (an alternation), in document order."""
    return F.regexp_extract_all(doc, F.lit(rf"(?is)<(?:{names}){_END}{REST}"), F.lit(0))


def elements_with_content(doc: Column, name: str, until: str, alone: str = "") -> Column:
    """Start tag plus content up to the next tag matching ``until``.

    ``alone`` names elements without content to list in the same document order.
    """
    extra = rf"|<(?:{alone}){_END}{REST}" if alone else ""
    return F.regexp_extract_all(doc, F.lit(rf"(?is)<(?:{name}){_END}{REST}.*?(?={until}|\z){extra}"), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([^\s/>]+)", 1))


def is_tag(tag: Column, names: str) -> Column:
    return tag.rlike(rf"(?i)^<(?:{names}){_END}")


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(_attr_pattern(name))


def attr(tag: Column, name: str) -> Column:
    """Attribute value: NULL when absent, '' when present without a value."""
    value = r"""(?s)^[^=]*+(?:=\s*+)?(?:"([^"]*+)"|'([^']*+)'|(.*))$"""
    return let(
        F.regexp_extract(tag, _attr_pattern(name), 1),
        lambda m: F.when(m != "", decode_entities(F.regexp_replace(m, value, "$1$2$3"), attribute=True)),
    )


def _attr_pattern(name: str) -> str:
    stop = rf"{re.escape(name)}(?=[\s/>=])"
    return rf"(?is)^<[^\s/>]++(?:[\s/]*+(?!{stop})[^\s/>][^\s/>=]*+{_VALUE})*+[\s/]*+({stop}{_VALUE})"


def attributes(tag: Column) -> Column:
    """All attributes as a map of lower-case names; the first of a name wins."""
    start = F.regexp_extract(tag, rf"(?s)^<[a-zA-Z][^\s/>]*+({REST})", 1)
    parts = F.regexp_extract_all(start, F.lit(_ATTR), F.lit(0))

    def pair(p: Column) -> Column:
        key = F.lower(F.regexp_extract(p, r"^[\s/]*+([^\s/>=]+)", 1))
        value = F.regexp_replace(p, r"""(?s)^[\s/]*+[^\s/>][^\s/>=]*+\s*+=?+\s*+(?:"([^"]*+)"|'([^']*+)'|(.*))$""", "$1$2$3")
        return F.struct(key.alias("key"), decode_entities(value, attribute=True).alias("value"))

    def first(pairs: Column, keys: Column) -> Column:
        return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == (i + 1).cast("long")))

    # A lambda evaluates what it names once for each item: pairs and their keys are made before it.
    return let(F.transform(parts, pair), lambda pairs: let(F.transform(pairs, lambda p: p["key"]), lambda keys: first(pairs, keys)))


def inner(part: Column) -> Column:
    """Content of a captured element (its start and end tags removed)."""
    return F.regexp_replace(part, rf"(?is)^<[^\s/>]++{REST}|</[^\s/>]++[^>]*+>\z", "")


def untagged(fragment: Column) -> Column:
    """Decoded text: line-breaking tags become spaces, other tags vanish."""

    def bare(f: Column) -> Column:
        spaced = F.regexp_replace(f, rf"(?is)</?(?:{_BLOCK}){_END}{REST}", " ")
        return F.regexp_replace(spaced, rf"(?s)</?[a-zA-Z]{REST}|<[!?][^>]*+>", "")

    return decode_entities(let(fragment, lambda f: F.when(f.contains("<"), bare(f)).otherwise(f)))


def text_of(fragment: Column) -> Column:
    """Rendered-like text of a fragment, white space collapsed."""
    return clean(untagged(fragment))


def raw_text(part: Column) -> Column:
    """Text content of a raw-text element, as written."""
    return F.regexp_replace(part, rf"(?is)^<[^\s/>]++{REST}|</(?:{_RAW}){_END}[^>]*+>\z", "")


def body_of(doc: Column) -> Column:
    """What follows the body start tag, else what follows the head."""
    cut = F.regexp_replace(doc, rf"(?is)^.*?<body{_END}{REST}", "")
    headless = F.regexp_replace(doc, rf"(?is)^.*?</head\s*+>", "")
    return F.when(doc.rlike(r"(?i)<body[\s>]"), cut).otherwise(headless)
