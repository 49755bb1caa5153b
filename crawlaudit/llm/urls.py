"""URL filter (operator 7) by the likelihood ratio of two character models.

Rules decide what they fit. Their verdicts label URLs: the accepted ones train one variable-order Markov model of
characters, the rejected ones another. A model's probability of a character after a context backs off through shorter
contexts by how often the longer one was seen. The score of a URL is the difference of the two log-likelihoods divided by
its length; the threshold is calibrated on labelled URLs.

Characters are folded to ``len(ALPHABET) + 1`` symbols, so a model of ``ORDER`` symbols has a fixed number of entries at most,
whatever the table, and may be broadcast; the URLs that need a score meet it in a hash join whose sums are combined before
their shuffle. Log ratios are whole micro-units, so that sums do not depend on their order. Each URL is scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

# The rules of the contract as (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&#%:@"
ORDER = 2
# Weight of the shorter contexts: as if they had been seen so often.
BACKOFF = 4.0
UNIT = 1_000_000
# Scores are cut to thousandths, so that there are few different ones, whatever the table.
STEP = 1000
# Share of the accepted URLs that the threshold may lose.
LOSS = 0.05
PAD = "^"


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*(/[^?#]*)?", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    fits = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        here = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(here, value) if fits is None else fits.when(here, value)
    return fits


def folded(host_: Column, path_: Column) -> Column:
    """The symbols of a URL: lower case, one symbol for all digits, one for whatever is not in the alphabet, padded."""
    text = F.regexp_replace(lower(F.concat(host_, path_)), "[0-9]", "0")
    other = "[^" + "".join("\\" + c if not c.isalnum() else c for c in ALPHABET) + "]"
    return F.concat(F.lit(PAD * ORDER), F.regexp_replace(text, other, "~"))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """Each symbol of ``f`` with the ORDER symbols before it, in ``g``."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("f") - ORDER, F.lit(1))), lambda i: F.substring("f", i, F.lit(ORDER + 1)))
    return urls.where(F.length("f") > ORDER).select(*keep, F.explode(places).alias("g"))


def model(labelled: DataFrame) -> DataFrame:
    """(g, ratio): the log ratio of accepted to rejected, in micro-units, of every gram seen in labelled URLs.

    A gram is the context's ORDER symbols and the symbol after it. With n(c) the count of a context and n(c, s) that of a
    symbol after it, p(s | c) = (n(c, s) + BACKOFF * p(s | shorter c)) / (n(c) + BACKOFF), down to equal chances.
    """
    counts = labelled.groupBy("g").agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")])
    counts = stage(counts, "grams")
    logs = {}
    table = counts.select("g", *[F.col(v).alias(f"{v}_n") for v in ("allow", "block")])
    for v in ("allow", "block"):
        chance = F.lit(1.0 / (len(ALPHABET) + 2))
        for order in range(ORDER + 1):
            context = F.substring("g", ORDER + 1 - order, order) if order else F.lit("")
            with_symbol = F.substring("g", ORDER + 1 - order, order + 1)
            own = F.sum(f"{v}_n").over(Window.partitionBy(with_symbol))
            all_ = F.sum(f"{v}_n").over(Window.partitionBy(context))
            table = table.withColumn(f"{v}_{order}", own).withColumn(f"{v}_{order}_all", all_)
            chance = (F.col(f"{v}_{order}") + BACKOFF * chance) / (F.col(f"{v}_{order}_all") + BACKOFF)
        logs[v] = F.log(chance)
    return table.select("g", F.round((logs["allow"] - logs["block"]) * UNIT).cast("long").alias("ratio"))


def judge(pages: DataFrame, rules=RULES, loss: float = LOSS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    A null URL, or one without ``://``, has an empty host and path. The score is null where a rule decides, and zero
    where no gram of the URL is known. A URL is blocked if its score is below the ``loss`` quantile of the accepted
    ones' scores; without labelled URLs of both verdicts nothing is blocked. Repeated rows give repeated rows, an empty
    table gives none, and other columns are not read.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = parts.withColumn("r", rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict", folded(F.col("host"), F.col("path")).alias("f"))
    parts = stage(parts, "urls")
    distinct = parts.select("f", "verdict").distinct()
    labelled = distinct.where("verdict is not null")
    ratios = F.broadcast(stage(model(grams(labelled, "verdict")), "ratios"))
    scored = grams(distinct, "f", "verdict").join(ratios, "g", "left").groupBy("f", "verdict")
    scored = scored.agg(F.floor(F.sum(F.coalesce("ratio", F.lit(0))) / (F.count("*") * STEP)).cast("long").alias("score"))
    scored = stage(scored, "scores")
    ranked = scored.where("verdict = 'allow'").groupBy("score").agg(F.count("*").alias("n"))
    bar = ranked.withColumn("below", F.sum("n").over(Window.orderBy("score"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    bar = bar.where(F.col("below") > F.col("all") * loss).agg(F.min("score").alias("bar"))
    blocked = scored.where("verdict = 'block'").limit(1).agg(F.count("*").alias("blocked"))
    known = [(r["bar"], b["blocked"]) for r, b in zip(bar.collect(), blocked.collect())][0]
    threshold = F.lit(known[0] if known[0] is not None and known[1] else None).cast("long")
    own = scored.where("verdict is null").select(F.col("f").alias("of"), "score")
    out = parts.join(own, parts["verdict"].isNull() & (parts["f"] == own["of"]), "left")
    method = F.when(F.coalesce(F.col("score"), F.lit(0)) < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.when(F.col("verdict").isNull(), F.coalesce("score", F.lit(0).cast("long"))).alias("score"))
