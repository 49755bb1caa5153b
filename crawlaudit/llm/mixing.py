"""Mixing sources to target weights (operator 2) by hierarchical budgeting.

Documents hang in a tree, such as domain, language, source. The token budget is dealt from the root down: the children of
a node share its budget by their weights, and none gets more than its subtree can supply, which is its tokens times the
number of epochs. What a child cannot use goes to its siblings by their weights; what a whole subtree cannot use was never
given to it but to the siblings of an ancestor. Amounts are integers, rounded down.

A leaf's budget is filled from seeded epochs: an epoch is the leaf's documents in an order of its own, drawn from the
seed, and the leaf takes the prefix of its epochs that holds its budget, cutting the last document. Whole epochs need no
order. In the last one the tokens are counted by ranges of the draw first, so that only the range in which the prefix
ends is sorted: a source that holds a third of all rows is neither sorted nor gathered in one task.

Only DataFrame operations run. The tree has one row for each leaf and is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, stage

RANGES = 1024
DRAW_BITS = 60


def words(text: Column) -> Column:
    """Tokens of a text: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, epoch: Column) -> Column:
    """A document's place in an epoch: 60 bits of a digest of the seed, the epoch and doc_id."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def deal(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Deal ``given``, the parent's budget, to its children by ``weight``, none above its ``supply``: adds ``got``.

    In the order of supply / weight the children fill up one after another; from the first that does not on, each gets
    its part of what is left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), child)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("given") - (F.sum("supply").over(so_far) - F.col("supply"))
    c = children.withColumn("left_", left).withColumn("weights_", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    short = wide("supply") * wide("weights_") <= wide("weight") * wide("left_")
    c = c.withColumn("pool_", F.first(F.when(~short, F.struct("left_", "weights_")), ignorenulls=True).over(so_far))
    part = F.expr("cast(weight as decimal(19,0)) * cast(pool_.left_ as decimal(19,0)) div cast(pool_.weights_ as decimal(19,0))")
    return c.withColumn("got", F.when(F.col("pool_").isNull(), F.col("supply")).otherwise(part)).drop("left_", "weights_", "pool_")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> list[Column]:
    return [left[c].eqNullSafe(right[f"{c}_"]) for c in columns]


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], fraction: float, epochs: int) -> DataFrame:
    """(levels, tokens, got): the tokens that each leaf gets of ``fraction`` times all tokens.

    ``weights`` gives a positive integer for a node of each level, from the columns down to that level.
    """
    tree = stage(leaves.withColumn("supply", F.col("tokens") * epochs), "leaves")
    given = None
    for i, level in enumerate(levels):
        above = levels[:i]
        children = tree.groupBy(*above, level).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("weight", weights[level].cast("long"))
        if given is None:
            everything = Window.partitionBy()
            budget = F.floor(F.sum("tokens").over(everything) * F.lit(fraction))
            children = children.withColumn("given", F.least(budget, F.sum("supply").over(everything)))
        else:
            children = children.join(given, _same(children, given, above)).drop(*[f"{c}_" for c in above])
        got = stage(deal(children, above, level), "budgets")
        given = got.select(*[F.col(c).alias(f"{c}_") for c in levels[: i + 1]], F.col("got").alias("given"))
    return tree.join(given, _same(tree, given, levels)).select(*levels, "tokens", F.col("given").alias("got"))


def mix(docs: DataFrame, levels: list[str], weights: dict[str, Column], fraction: float, epochs: int, seed: int, tokens: Column) -> DataFrame:
    """(doc_id, levels, text_hash, epoch, tokens, taken): the documents of the mix, once for each epoch that takes them.

    ``taken`` is less than ``tokens`` only for the document in which a leaf's prefix ends. A null level is a node of its
    own; documents without tokens are never taken; rows that repeat a doc_id are rows of their own. An empty table, or a
    budget of zero, gives no rows.
    """
    rows = docs.select("doc_id", *levels, F.xxhash64("text").alias("text_hash"), tokens.alias("tokens")).where("tokens > 0")
    rows = stage(rows, "rows")
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    got = budgets(leaves, levels, weights, fraction, epochs)
    plan = got.select(*[F.col(c).alias(f"{c}_") for c in levels], F.expr("got div tokens").alias("whole"), (F.col("got") % F.col("tokens")).alias("rest"))
    plan = stage(plan, "plan")
    dealt = rows.join(plan, _same(rows, plan, levels)).drop(*[f"{c}_" for c in levels])
    columns = ["doc_id", *levels, "text_hash", "epoch", "tokens", "taken"]
    whole = dealt.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "whole"))).withColumn("taken", F.col("tokens"))

    last = dealt.where("rest > 0").withColumn("epoch", F.col("whole") + 1)
    last = last.withColumn("draw", draw(seed, F.col("epoch")))
    last = stage(last.withColumn("range", F.expr(f"draw div {(1 << DRAW_BITS) // RANGES}")), "drawn")
    ranges = last.groupBy(*levels, "range").agg(F.sum("tokens").alias("held"))
    ranges = ranges.withColumn("before", F.sum("held").over(Window.partitionBy(*levels).orderBy("range")) - F.col("held"))
    ranges = stage(ranges.select(*[F.col(c).alias(f"{c}_") for c in [*levels, "range"]], "held", "before"), "ranges")
    placed = last.join(ranges, _same(last, ranges, [*levels, "range"])).where("before < rest")
    inside = placed.where("before + held <= rest").withColumn("taken", F.col("tokens"))
    edge = placed.where("before + held > rest")
    order = Window.partitionBy(*levels, "range").orderBy("draw", "doc_id", "tokens", "text_hash")
    edge = edge.withColumn("before", F.col("before") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    edge = edge.where("before < rest").withColumn("taken", F.least("tokens", F.col("rest") - F.col("before")))
    return whole.select(columns).unionByName(inside.select(columns)).unionByName(edge.select(columns))


# The mix of the registered query and of the pipeline.
LEVELS = ["domain", "lang", "source"]
SEED = 7


def domain() -> Column:
    """The tables name no domains: sources are dealt to four by their number."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def target_weights() -> dict[str, Column]:
    return {
        "domain": F.element_at(F.create_map(*[F.lit(x) for pair in {"d0": 4, "d1": 3, "d2": 2, "d3": 1}.items() for x in pair]), F.col("domain")),
        "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).otherwise(2),
        "source": F.lit(1),
    }


def mix_documents(docs: DataFrame, fraction: float, epochs: int) -> DataFrame:
    """:func:`mix` of a documents table by domain, language and source."""
    return mix(docs.withColumn("domain", domain()), LEVELS, target_weights(), fraction, epochs, SEED, words(F.col("text")))


def keep_mix(docs: DataFrame, fraction: float) -> DataFrame:
    """The rows of ``docs`` that one epoch of the mix takes, whole and as they were."""
    taken = stage(mix_documents(docs, fraction, 1).select("doc_id", "text_hash").distinct(), "taken")
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["doc_id"]) & (F.xxhash64(docs["text"]) == taken["text_hash"]), "left_semi")
