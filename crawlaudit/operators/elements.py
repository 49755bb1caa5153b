"""The element tree of a page as intervals (S2): start and end of every element, and questions about containment.

A page's tags become rows with their place. Where an element ends follows from running sums and from the next row of a
level, so no stack is kept and no row is looked at twice; every window lies within one page, and one dealing by page serves
them all: pages that lie in buckets of ``page_id``, or are dealt by it, need no further exchange. A window holds the tags of a
page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import html as H
from .extract import parse

# Elements without an end tag, and groups whose members end where the next member of one parent begins.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
IMPLIED = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "tr": ["tr", "tbody", "thead", "tfoot"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"]}
# What ends a paragraph that has no end tag.
ENDS_PARAGRAPH = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
                  "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
IMPLIED["p"] = ENDS_PARAGRAPH
_END = 1 << 40


TAG = r"^</?[a-zA-Z]"


def markup_lists(pages: DataFrame) -> DataFrame:
    """(page_id, tokens, base): the tags of a page and the texts between them as one list, and the address that links start from."""
    token = rf"(?s)</?[a-zA-Z][^\s/>]*+{H.REST}|[^<]++|<"
    return parse(pages).select("page_id", F.regexp_extract_all("_doc", F.lit(token), F.lit(0)).alias("tokens"), F.col("_base").alias("base"))


def markup(pages: DataFrame) -> DataFrame:
    """(page_id, pos, token): tags and the texts between them, in document order; comments and raw text are left out."""
    return placed(markup_lists(pages))


def placed(lists: DataFrame) -> DataFrame:
    """(page_id, pos, token) of :func:`markup_lists`."""
    return lists.select("page_id", F.posexplode("tokens").alias("pos", "token"))


def owned(rows: DataFrame, flag: Column, name: str = "owner", **carried: Column) -> DataFrame:
    """Rows (page_id, start, end, ...) with ``name`` and ``name_end``: the innermost flagged row around each, NULL if none.

    Flagged rows open and close levels; at a row's place the last flagged row that opened the current level is around it.
    ``carried`` names further columns, with what they say of the row around. Each row is read once and brings its events.
    """
    columns = rows.columns
    rows = rows.withColumns({"_flag": F.coalesce(flag, F.lit(False)), **{f"_carried_{n}": c for n, c in carried.items()}})
    # The page stays a column of its own, so rows dealt by it still are.
    kept = F.struct(*[c for c in columns if c != "page_id"])
    around = F.struct(F.col("start").alias(name), F.col("end").alias(f"{name}_end"), *[F.col(f"_carried_{n}").alias(n) for n in carried])
    none = lambda c: F.when(F.lit(False), c)
    event = lambda at, turn, step, row, opened: F.struct(F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(step).alias("step"), row.alias("row"), opened.alias("opened"))
    child, opens, closes = event("start", 1, 0, kept, none(around)), event("start", 2, 1, none(kept), F.when(F.col("_flag"), around)), event("end", 0, -1, none(kept), none(around))
    events = rows.select("page_id", F.inline(F.when(F.col("_flag"), F.array(child, opens, closes)).otherwise(F.array(child))))
    order = [F.col("at"), F.col("turn")]
    events = events.withColumn("level", F.sum("step").over(W.partitionBy("page_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy("page_id", "level").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = events.withColumn("around", F.when(F.col("level") > 0, F.last("opened", ignorenulls=True).over(before))).where("row is not null")
    return found.select(*["page_id" if c == "page_id" else F.col("row")[c].alias(c) for c in columns], "around.*")


def elements(tokens: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(page_id, start, end, name, tag) of every element of :func:`markup`: it holds what stands at start < place < end.

    An element ends at its own end tag, by name and depth; end tags without a start tag say nothing. Void elements hold
    nothing. Where end tags may be left out, an element ends at the next one of its group under the same parent. What has
    no end otherwise ends with the element around it, or with the page. All tags count; where ``wanted`` picks from ``tag``
    only what it picks is returned, and no other row carries its tag along.
    """
    tags = tokens.where(F.col("token").rlike(TAG))
    name = F.lower(F.regexp_extract("token", r"^</?([^\s/>]+)", 1))
    way = F.when(F.startswith("token", F.lit("</")), -1).otherwise(1)
    rows = tags.select("page_id", F.col("pos").cast("bigint").alias("start"), name.alias("name"), way.alias("way"), F.col("token").alias("tag"))
    # End tags are known by name and place.
    rows = rows.withColumn("tag", F.when((F.col("way") > 0) & (F.lit(True) if wanted is None else wanted), F.col("tag")))
    void, implied = F.col("name").isin(VOID), F.col("name").isin(sorted(IMPLIED))
    rows = rows.where(~(void & (F.col("way") < 0)))
    # Depth by name, end tags without a start left out of account: they are new lows of the running sum.
    upto = W.partitionBy("page_id", "name").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("way").over(upto))
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto)))
    earlier = F.coalesce(F.lag("_low").over(W.partitionBy("page_id", "name").orderBy("start")), F.lit(0))
    rows = rows.withColumn("_stray", (F.col("way") < 0) & (F.col("_sum") < earlier))
    rows = rows.where("not _stray").withColumn("_depth", F.col("_sum") - F.col("_low") + F.when(F.col("way") < 0, 1).otherwise(0))
    mate = F.lead(F.struct("start", "way")).over(W.partitionBy("page_id", "name", "_depth").orderBy("start"))
    rows = rows.withColumn("_mate", mate)
    strict = (F.col("way") > 0) & ~void & ~implied
    closed = F.when(void, F.col("start")).when(strict & (F.col("_mate.way") < 0), F.col("_mate.start"))
    rows = rows.withColumn("end", closed).select("page_id", "start", "end", "name", "way", "tag")
    # The parent of what may be left open is the innermost element with an end tag of its own.
    rows = owned(rows, (F.col("way") > 0) & F.col("end").isNotNull() & ~F.col("name").isin(VOID), "parent")
    # Read backwards, so that what follows is a running minimum and many children of one parent stay linear.
    after = W.partitionBy("page_id", "parent").orderBy(F.desc("start")).rowsBetween(W.unboundedPreceding, -1)
    ends = F.lit(None).cast("bigint")
    for one, group in sorted(IMPLIED.items()):
        stops = ((F.col("way") > 0) & F.col("name").isin(group)) | ((F.col("way") < 0) & (F.col("name") == one))
        ends = F.when(F.col("name") == one, F.min(F.when(stops, F.col("start"))).over(after)).otherwise(ends)
    rows = rows.withColumn("_next", ends).where("way > 0")
    end = F.coalesce("end", F.least(F.coalesce("_next", F.lit(_END)), F.coalesce("parent_end", F.lit(_END))))
    return rows.select("page_id", "start", end.alias("end"), "name", "tag").where("tag is not null")


def select_within(rows: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """Rows that ``inner`` picks inside any row that ``outer`` picks: the descendant selector.

    A row is inside one of the outer rows before it if the furthest of their ends lies behind it.
    """
    reach = F.max(F.when(outer, F.col("end"))).over(W.partitionBy("page_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_reach", reach).where(inner & (F.col("_reach") > F.col("start"))).drop("_reach")


def select_children(rows: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """Rows that ``inner`` picks whose innermost element around is one that ``outer`` picks: the child selector."""
    return owned(rows, F.col("end") > F.col("start"), "_owner", _outer=outer).where(inner & F.col("_outer")).select(*rows.columns)


def select_paths(rows: DataFrame, conditions: dict[str, Column], paths: dict[str, tuple[str, ...]]) -> DataFrame:
    """(selector, and the columns of ``rows``): the rows that each path picks, for many paths in one go.

    A path names conditions with " " (inside) or ">" (child) between them; its key is the selector in the result. Each
    condition is looked at once per row. Paths of equal beginnings share it, the ends of all that is looked for inside are
    windows of one order, and one look at the elements around serves all child steps of a depth.
    """
    columns = rows.columns
    flags = {(n,): f"_c_{i}" for i, n in enumerate(conditions)}
    rows = rows.select("*", *[F.coalesce(c, F.lit(False)).alias(flags[(n,)]) for n, c in conditions.items()])
    for depth in range(3, max(map(len, paths.values())) + 1, 2):
        steps = sorted({p[:depth] for p in paths.values() if len(p) >= depth})
        outer = {how: sorted({s[:-2] for s in steps if s[-2] == how}) for how in (" ", ">")}
        if outer[">"]:
            around = {f"_in_{depth}_{i}": F.col(flags[o]) for i, o in enumerate(outer[">"])}
            rows = owned(rows, F.col("end") > F.col("start"), f"_owner_{depth}", **around)
        before = W.partitionBy("page_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumns({f"_reach_{depth}_{i}": F.max(F.when(F.col(flags[o]), F.col("end"))).over(before) for i, o in enumerate(outer[" "])})
        for i, step in enumerate(steps):
            place = outer[step[-2]].index(step[:-2])
            inside = F.col(f"_reach_{depth}_{place}") > F.col("start") if step[-2] == " " else F.col(f"_in_{depth}_{place}")
            flags[step] = f"_f_{depth}_{i}"
            rows = rows.withColumn(flags[step], F.col(flags[step[-1:]]) & F.coalesce(inside, F.lit(False)))
    picked = F.array_compact(F.array(*[F.when(F.col(flags[p]), F.lit(s)) for s, p in paths.items()]))
    return rows.select(F.explode(picked).alias("selector"), *columns)


def texts_within(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(page_id, start, text): the text of elements, white space collapsed, that of the elements inside them included.

    Each text token meets the elements around it; elements without text are left out.
    """
    texts = tokens.where(~F.col("token").rlike(TAG)).select(F.col("page_id").alias("_page"), F.col("pos").alias("_at"), "token")
    met = rows.select("page_id", "start", "end").join(texts, (F.col("page_id") == F.col("_page")) & (F.col("_at") > F.col("start")) & (F.col("_at") < F.col("end")))
    parts = F.array_sort(F.collect_list(F.struct("_at", "token")))
    return met.groupBy("page_id", "start").agg(H.clean(H.decode_entities(F.array_join(F.transform(parts, lambda p: p["token"]), ""))).alias("text"))


def text_between(tokens: Column, start: Column, end: Column) -> Column:
    """The text of one element out of its page's list of tokens: '' if it has none."""
    inside = F.slice(tokens, (start + 2).cast("int"), F.greatest(F.least(end, F.size(tokens)) - start - 1, F.lit(0)).cast("int"))
    return H.clean(H.decode_entities(F.array_join(F.filter(inside, lambda t: ~t.rlike(TAG)), "")))
