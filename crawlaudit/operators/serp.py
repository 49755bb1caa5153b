"""Questions people also ask, from result pages of a search engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, urls as U
from ..functions.text import clean, let

# How the box is titled.
BOX_TITLES = (
    "^(?i)(?:people also ask|autres questions posées|d'autres questions|les internautes ont aussi demandé|"
    "las personas también preguntan|más preguntas|andere fragen|ähnliche fragen|altre domande|outras perguntas|"
    "as pessoas também perguntam|mensen vragen ook)")
_EMPTY = "struct<answer:string,source:string,title:string>"
# A tag that opens something: its name, its attributes, what stands before the same name closes.
_TOGGLE = r"(?is)<([a-z][a-z0-9-]*)(?=[^>]*\s(?:aria-expanded|role\s*=\s*[\"']?button)(?=[\s=\"'>]))[^>]*>.*?</\1\s*>"
_HEADING = r"(?is)<(h[1-6])(?=[\s>])[^>]*>.*?</\1\s*>"


def _element(piece: Column) -> Column:
    """The element that ``piece`` begins with: up to where as many of its tags close as open."""
    name = F.regexp_extract(piece, r"^<([A-Za-z][A-Za-z0-9-]*)", 1)

    def balanced(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        step = lambda acc, p: F.when(acc["done"], acc).otherwise(let(
            acc["depth"] + F.when(p.startswith("</"), -1).when(p.startswith("<"), 1).otherwise(0),
            lambda d: F.struct(d.alias("depth"), (acc["n"] + 1).alias("n"), ((d == 0) & p.startswith("</")).alias("done"))))
        return let(F.aggregate(parts, start, step), lambda end: F.array_join(F.slice(parts, 1, F.when(end["done"], end["n"] - 1).otherwise(end["n"])), ""))

    return let(F.split(piece, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])"))), balanced)


def _blocks(doc: Column, having: str) -> Column:
    """Elements whose start tag matches, whole, in document order."""
    pieces = F.split(doc, rf"(?is)(?=<[a-z][^<>]*{having}[^<>]*>)")
    return F.transform(F.filter(pieces, lambda p: p.rlike(rf"(?is)^<[a-z][^<>]*{having}")), _element)


def _answer(block: Column, toggle: Column, closed: Column) -> Column:
    """What an open question's block says besides the question, and the first address outside the search engine."""
    outside = r"(?is)<a(?=\s)[^>]*\shref\s*=\s*[\"']?https?://(?![^/\"'>]*(?<![a-z0-9-])google\.)[^>]*>.*?</a\s*>"
    link = F.regexp_extract(block, outside, 0)
    heading = H.text_of(F.regexp_extract(link, r"(?is)<h3[^>]*>.*?</h3\s*>", 0))
    title = F.when(heading != "", heading).otherwise(H.text_of(link))
    text = F.replace(F.replace(block, toggle, F.lit(" ")), F.when(link.contains("<h3"), F.regexp_extract(link, r"(?is)<h3[^>]*>.*?</h3\s*>", 0)).otherwise(link), F.lit(" "))
    said = F.struct(H.text_of(text).alias("answer"), F.coalesce(H.attr(F.regexp_extract(link, "(?s)^<[^>]*>", 0), "href"), F.lit("")).alias("source"), title.alias("title"))
    return F.when(~closed & (toggle != ""), said).otherwise(F.struct(*[F.lit("").alias(n) for n in ("answer", "source", "title")]).cast(_EMPTY))


def _row(signal: int, question: Column, answer: Column) -> Column:
    return F.struct(F.lit(signal).alias("signal"), clean(question).alias("question"), answer.alias("said"))


def _asked(signal: int, block: Column, attribute: str | None) -> Column:
    toggle = F.regexp_extract(block, _TOGGLE, 0)
    closed = toggle.rlike(r"(?is)^<[^>]*\saria-expanded\s*=\s*[\"']?false")
    question = H.text_of(toggle) if attribute is None else H.attr(F.regexp_extract(block, "(?s)^<[^>]*>", 0), attribute)
    return _row(signal, F.coalesce(question, F.lit("")), _answer(block, toggle, closed))


def _titled(doc: Column) -> Column:
    """Toggles between a box title and the next heading."""
    parts = F.split(doc, rf"(?i)(?=<h[1-6][\s>])")
    boxes = F.filter(parts, lambda p: H.text_of(F.regexp_extract(p, _HEADING, 0)).rlike(BOX_TITLES))
    toggles = F.flatten(F.transform(boxes, lambda p: F.regexp_extract_all(p, F.lit(_TOGGLE), F.lit(0))))
    blank = F.struct(*[F.lit("").alias(n) for n in ("answer", "source", "title")]).cast(_EMPTY)
    return F.transform(F.filter(toggles, lambda t: t.rlike(r"(?is)^<[^>]*\saria-expanded")), lambda t: _row(4, H.text_of(t), blank))


def people_also_ask(pages: DataFrame) -> DataFrame:
    """(page_id, idx, question, answer, source, source_title); the first spelling of a question wins.

    Questions stand in attributes, in the toggles of question blocks, and in toggles below a box title, in this order.
    All of it happens inside the page's row.
    """
    doc = F.col("doc")
    found = F.concat(
        F.transform(_blocks(doc, r"\sdata-q\s*="), lambda b: _asked(1, b, "data-q")),
        F.transform(_blocks(doc, r"\sdata-initq\s*="), lambda b: _asked(2, b, "data-initq")),
        F.transform(_blocks(doc, r"\sclass\s*=\s*[\"']?[^\"'>]*related-question-pair"), lambda b: _asked(3, b, None)),
        _titled(doc),
    )
    serps = pages.where(U.is_serp(F.col("url"))).select("page_id", H.masked(F.col("html")).alias("doc"))
    listed = serps.select("page_id", F.filter(found, lambda q: q["question"] != "").alias("found"))
    names = F.transform("found", lambda q: F.lower(q["question"]))
    firsts = F.filter("found", lambda q, i: F.array_position(names, F.lower(q["question"])) == (i + 1).cast("long"))
    rows = listed.select("page_id", F.posexplode(firsts).alias("idx", "q"))
    source = F.col("q.said.source")
    return rows.select(
        "page_id", "idx", "q.question", F.col("q.said.answer").alias("answer"),
        F.when(source != "", U.normalize(source)).otherwise("").alias("source"), F.col("q.said.title").alias("source_title"),
    )
