"""Structured data: JSON-LD validity and types, microdata items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import html as H, jsontext as J, text as T, urls as U
from . import elements as EL
from .extract import children, parse
from .skew import bucketed, staged


def jsonld_blocks(records: DataFrame) -> DataFrame:
    """(page_id, idx, ok, json, error_text): one row per block.

    Validity is strict: no NaN, no trailing text. ``json`` is the block without white space, NULL when it is not valid;
    then ``error_text`` is the block as written.
    """
    blocks = children(records, "jsonld").withColumn("ok", J.is_valid(F.col("value")))
    return blocks.select("page_id", "idx", "ok", F.when(F.col("ok"), J.compact(F.col("value"))).alias("json"), F.when(~F.col("ok"), F.col("value")).alias("error_text"))


def schema_types(blocks: DataFrame) -> DataFrame:
    """(page_id, idx, type): distinct @type values at any depth, members of @context left out.

    A block's tokens become rows with their bracket depth. The value of a member ends where the next token of the
    member's own depth stands, which a window over equal depths finds; nothing recurses and no depth is too deep. A
    window holds the tokens of one block.
    """
    rows = blocks.where("ok").select("page_id", "idx", F.posexplode(J.tokens(F.col("json"))).alias("pos", "token"))
    block = W.partitionBy("page_id", "idx").orderBy("pos")
    change = F.when(F.col("token").isin("{", "["), 1).when(F.col("token").isin("}", "]"), -1).otherwise(0)
    rows = rows.withColumns({"depth": F.sum(change).over(block), "name": F.when(F.col("token") == ":", F.lag("token").over(block))})
    level = W.partitionBy("page_id", "idx", "depth").orderBy("pos")
    rows = rows.withColumn("last", F.when(F.col("token") == ":", F.lead("pos").over(level)))
    span = lambda name: F.collect_list(F.when(F.col("name") == F.lit(f'"{name}"'), F.struct("pos", "last", "depth")))
    texts = F.collect_list(F.when(F.col("token").startswith('"'), F.struct("pos", "token", "depth")))
    per = rows.groupBy("page_id", "idx").agg(span("@type").alias("types"), span("@context").alias("contexts"), texts.alias("texts")).where(F.size("types") > 0)
    inside = lambda x, spans: F.exists(spans, lambda c: (c["pos"] < x["pos"]) & (x["pos"] <= c["last"]))
    # The string itself, or the strings of a list, one bracket deeper.
    named = lambda t: F.exists("types", lambda m: (m["pos"] < t["pos"]) & (t["pos"] <= m["last"]) & (t["depth"] <= m["depth"] + 1))
    found = F.filter("texts", lambda t: named(t) & ~inside(t, F.col("contexts")))
    names = F.array_distinct(F.transform(F.array_sort(found), lambda t: J.unquoted(t["token"])))
    return per.select("page_id", "idx", F.explode(names).alias("type"))


def microdata_type_name(type_: Column) -> Column:
    """Readable item type: schema.org prefix cut, several types joined."""
    names = F.transform(F.split(type_, r"\s+"), lambda t: F.regexp_replace(t, r"(?i)^https?://schema\.org/", ""))
    return F.when(F.coalesce(type_, F.lit("")) == "", "Untyped item").otherwise(F.array_join(names, ", "))


# Where an element keeps its property value.
_FROM_SRC = ["audio", "embed", "iframe", "img", "source", "track", "video"]
_FROM_HREF = ["a", "area", "link"]


def microdata(pages: DataFrame, max_roots: int | None = None) -> DataFrame:
    """Flat microdata rows per page (E11): items (``item`` set) and plain properties.

    ``parent`` is the owning item, ``prop`` the property name; a root item has neither. The owner of a property is the
    innermost item around its element in the element tree. An item that is a property but lies in no item is none, and
    what is inside it belongs to nobody.
    """
    lists = bucketed(EL.markup_lists(pages.where(F.col("html").rlike("(?i)itemscope"))), "page_id")
    attr = lambda n: F.col("attrs")[n]
    words = lambda c: T.clean(F.coalesce(c, F.lit("")))
    marked = EL.elements(EL.placed(lists), F.col("tag").rlike(r"(?i)\sitem(?:scope|prop)(?=[\s/>=])"))
    marked = marked.select("page_id", "start", "end", "name", H.attributes(F.col("tag")).alias("attrs"))
    marked = marked.select("*", attr("itemscope").isNotNull().alias("scope"), attr("itemprop").alias("props")).where("scope or props is not null")
    is_root = F.col("scope") & F.col("props").isNull()
    marked = EL.owned(marked, is_root, "around")
    # A root is its own; any other item or property needs a root around it.
    marked = marked.withColumn("root_at", F.when(is_root, F.col("start")).otherwise(F.col("around"))).where("root_at is not null")
    upto = W.partitionBy("page_id").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("item", (F.count(F.when(F.col("scope"), 1)).over(upto) - 1).cast("int"))
    rows = EL.owned(marked, F.col("scope"), "owner", parent=F.col("item"))
    rows = rows.withColumn("root", F.min("item").over(W.partitionBy("page_id", "root_at")))
    rows = rows.join(lists.withColumnRenamed("page_id", "_page"), F.col("page_id") == F.col("_page"), "left").drop("_page")
    name = F.col("name")
    source = F.when(name.isin(_FROM_SRC), attr("src")).when(name.isin(_FROM_HREF), attr("href")).when(name == "object", attr("data"))
    address = name.isin([*_FROM_SRC, *_FROM_HREF, "object"])
    value = (
        F.when(attr("content").isNotNull(), attr("content")).when(address, F.coalesce(U.resolve(source, F.col("base")), F.lit("")))
        .when(name.isin("data", "meter"), attr("value")).when((name == "time") & (F.coalesce(attr("datetime"), F.lit("")) != ""), attr("datetime"))
        .otherwise(F.coalesce(EL.text_between(F.col("tokens"), F.col("start"), F.col("end")), F.lit("")))
    )
    names = F.when(F.col("props").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.split(words(F.col("props")), " "))
    rows = rows.select(
        "page_id", "start", "root", F.when(F.col("scope"), F.col("item")).alias("item"), F.when(F.col("props").isNotNull(), F.col("parent")).alias("parent"), names.alias("names"),
        F.when(F.col("scope"), words(attr("itemtype"))).alias("type"), F.when(F.col("scope"), T.blank_to_null(attr("itemid"))).alias("itemid"), F.when(~F.col("scope"), value).alias("value"),
    )
    rows = rows.select("*", F.posexplode("names").alias("_n", "prop"))
    if max_roots is not None:
        rows = rows.withColumn("_r", F.dense_rank().over(W.partitionBy("page_id").orderBy("root"))).where(F.col("_r") <= max_roots)
    ord_ = F.row_number().over(W.partitionBy("page_id").orderBy("start", "_n")) - 1
    return rows.select("page_id", ord_.alias("ord"), "root", "item", "parent", "prop", "type", "itemid", "value")


def microdata_objects(rows: DataFrame) -> DataFrame:
    """(page_id, item, json): every root item as one JSON object, repeats as arrays.

    A group is one root item of one page. Its items are folded from the last to the first: an item is met before the items
    inside it, so backwards the text of every inner one is there.
    """
    say = lambda c: F.coalesce(J.quoted(c), F.lit("null"))
    row = F.struct("ord", "item", "parent", "prop", "value", microdata_type_name(F.col("type")).alias("type_name"), "itemid")
    per = rows.groupBy("page_id", "root").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # An item that is several properties has a row for each.
    firsts = F.aggregate("rows", F.array().cast("array<int>"), lambda have, r: F.when(r["item"].isNull() | F.array_contains(have, r["item"]), have).otherwise(F.concat(F.array(r["item"]), have)))
    text_of = lambda texts, m: F.when(m["item"].isNotNull(), F.element_at(texts, m["item"])).otherwise(say(m["value"]))

    def members(texts: Column, mine: Column) -> Column:
        props = F.array_distinct(F.transform(mine, lambda m: m["prop"]))

        def one(p: Column) -> Column:
            values = F.transform(F.filter(mine, lambda m: m["prop"] == p), lambda m: text_of(texts, m))
            joined = T.let(values, lambda v: F.when(F.size(v) == 1, v[0]).otherwise(F.concat(F.lit("["), F.array_join(v, ","), F.lit("]"))))
            return F.concat(say(p), F.lit(":"), joined)

        return F.transform(props, one)

    def add(texts: Column, item: Column) -> Column:
        head = F.get(F.filter("rows", lambda r: r["item"] == item), F.lit(0))
        mine = F.filter("rows", lambda r: r["parent"] == item)
        start = T.let(head, lambda h: F.array_compact(F.array(F.concat(F.lit('"@type":'), say(h["type_name"])), F.when(h["itemid"].isNotNull(), F.concat(F.lit('"@id":'), say(h["itemid"]))))))
        text = F.concat(F.lit("{"), F.array_join(F.concat(start, T.let(mine, lambda m: members(texts, m))), ","), F.lit("}"))
        return F.map_concat(texts, F.map_from_arrays(F.array(item), F.array(text)))

    folded = F.aggregate(firsts, F.expr("cast(map() as map<int,string>)"), add)
    return per.select("page_id", F.col("root").alias("item"), F.element_at(folded, F.col("root")).alias("json"))


def schema_summary(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, schema_items, types): items per page and the union of type names."""
    # Both inputs are read more than once: they are stored.
    blocks, roots = staged(blocks.where("ok")), staged(items.where("item is not null and parent is null").select("page_id", "type"))
    types = staged(schema_types(blocks))
    # A block without a type still counts as one item.
    per = types.groupBy("page_id", "idx").agg(F.count("*").alias("types"))
    n = blocks.join(per, ["page_id", "idx"], "left").groupBy("page_id").agg(F.sum(F.coalesce("types", F.lit(1))).alias("n"))
    m = roots.groupBy("page_id").agg(F.count("*").alias("n"))
    names = types.select("page_id", "type").unionByName(roots.select("page_id", microdata_type_name(F.col("type")).alias("type"))).distinct()
    # The distinct type names of one page.
    listed = names.groupBy("page_id").agg(F.array_sort(F.collect_list("type")).alias("types"))
    total = n.unionByName(m).groupBy("page_id").agg(F.sum("n").alias("schema_items"))
    none = F.array().cast("array<string>")
    return total.join(listed, "page_id", "left").select("page_id", "schema_items", F.coalesce("types", none).alias("types"))
