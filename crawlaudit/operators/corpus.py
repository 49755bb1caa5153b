"""Corpus questions (C1-C5, U9): counts per domain, known addresses, mentions, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from .skew import lookup_join, staged


def pages_per_domain(pages: DataFrame) -> DataFrame:
    """(domain, pages): pages of each bare host, combined before the shuffle."""
    return pages.select(U.bare_host(F.col("url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("pages"))


def pages_of_domain(pages: DataFrame, domain: str) -> DataFrame:
    """Pages of one domain."""
    return pages.where(U.bare_host(F.col("url")) == domain)


def indexed(pages: DataFrame, url_index: DataFrame, known: bool = True) -> DataFrame:
    """Pages whose bare address is in the index table, or is not."""
    keyed = pages.withColumn("bare_url", U.bare_url(F.col("url")))
    return keyed.join(url_index.select("bare_url").distinct(), "bare_url", "left_semi" if known else "left_anti")


def domain_mentions(texts: DataFrame, domains: DataFrame, own: str = "host") -> DataFrame:
    """(domain, host, mentions): how often a domain is named in texts of other sites.

    ``texts`` has host and text. Tokens are counted per (host, token) before they meet
    the domain list, so a domain everybody names reaches the join already combined.
    """
    token = r"(?i)(?<![a-z0-9.@-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}(?![a-z0-9-])"
    found = texts.select(F.col(own).alias("host"), F.explode(F.regexp_extract_all("text", F.lit(token), F.lit(0))).alias("t"))
    found = found.select("host", F.regexp_replace(F.lower("t"), r"^www\.", "").alias("domain"))
    counts = found.where(F.col("domain") != F.coalesce("host", F.lit(""))).groupBy("host", "domain").agg(F.count("*").alias("mentions"))
    return lookup_join(counts, domains.select("domain").distinct(), ["domain"], "inner").select("domain", "host", "mentions")


def _phrases(pages: DataFrame, text: Column) -> DataFrame:
    return pages.select("page_id", T.exact_phrase(text, None).alias("phrase")).where(F.col("phrase") != "")


def _repeated(phrases: DataFrame) -> DataFrame:
    return phrases.groupBy("phrase").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


def phrase_copies(pages: DataFrame, text: Column) -> DataFrame:
    """(phrase, pages, first_page): whole phrases that more than one page carries (C4)."""
    return _repeated(_phrases(pages, text))


def phrase_copy_members(pages: DataFrame, text: Column) -> DataFrame:
    """(page_id, phrase, pages, first_page): each page whose phrase is repeated (C4).

    Phrases are extracted once and stored. One row per page, never a pair: a phrase on a third of the crawl stays
    linear, and the join back to its count is salted.
    """
    phrases = staged(_phrases(pages, text))
    return lookup_join(phrases, _repeated(phrases), ["phrase"], "inner").select("page_id", "phrase", "pages", "first_page")


# Anchors are runs of RUN words, the least of any WINDOW runs in a row; LONG words from there on say more.
RUN, WINDOW, LONG = 4, 5, 8
# By level, the words that a phrase needs. Its first anchor begins within its first WINDOW words.
LEAST_WORDS = [LONG + WINDOW - 1, RUN + WINDOW - 1, 1]


def winnowed(rows: DataFrame, key: str, words: str, levels: list[int]) -> DataFrame:
    """(``key``, level, anchor, place): at level 0 LONG words, at level 1 RUN words from each anchor on; at level 2 every word.

    Of any WINDOW runs in a row those of smallest hash are anchors, so two texts that share RUN + WINDOW - 1 words in a row share
    one, although about 2 / (WINDOW + 1) of the runs are kept. A word's row holds the hashes around it, so a run is compared with
    its neighbours where it stands.
    """
    around = WINDOW - 1
    last = max(around + RUN, LONG) - 1
    none = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    hashes = rows.select(key, F.concat(none(around), F.transform(words, lambda x: F.xxhash64(x)), none(last)).alias("_h"))
    # Slices of one length side by side: element i has the words from i - around to i + last.
    n = F.greatest(F.size("_h") - around - last, F.lit(0))
    names = [f"_{i}" for i in range(around + last + 1)]
    side_by_side = F.arrays_zip(*[F.slice("_h", i + 1, n).alias(name) for i, name in enumerate(names)], F.sequence(F.lit(0), n).alias("_place"))
    at = hashes.select(key, F.inline(side_by_side).alias(*names, "_place")).where(F.col(names[around]).isNotNull())

    def run(d: int, size: int = RUN) -> Column:
        own = [F.col(x) for x in names[around + d:around + d + size]]
        return F.when(own[0].isNotNull() & own[-1].isNotNull(), F.xxhash64(*own))

    def no_less(sign: int) -> Column:
        """How many runs on one side, counted from the run on, are no less than it; at most all that share a window with it."""
        count = None
        for d in range(1, around + 1):
            less = ~F.coalesce(run(sign * d) >= run(0), F.lit(False))
            count = F.when(less, d - 1) if count is None else count.when(less, d - 1)
        return count.otherwise(around)

    kept = no_less(-1) + no_less(1) >= around
    anchor = lambda level, h: F.struct(F.lit(level).alias("level"), h.alias("anchor"))
    of_runs = [anchor(0, run(0, LONG))] * (0 in levels) + [anchor(1, run(0))] * (1 in levels)
    if 2 in levels:
        word = [anchor(2, F.col(names[around]))]
        made = F.when(kept, F.array(*of_runs, *word)).otherwise(F.array(*word)) if of_runs else F.array(*word)
    else:
        at, made = at.where(kept), F.array(*of_runs)
    made = at.select(key, (F.col("_place") + 1).alias("place"), F.inline(made))
    return made.where("anchor is not null").select(key, "level", "anchor", "place")


def passage_copies(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(phrase, doc_id): documents that hold the exact, whole phrase of a passage.

    Documents and phrases are winnowed alike: of every window of word runs the one of smallest hash is an anchor, so a text
    that holds a phrase shares an anchor with it, although less than a quarter of its runs are anchors. Shorter phrases take
    shorter runs, and only for them are those of the documents made. A phrase brings one anchor, its first. What meets it is
    stored as places, and only documents with such a place are read again, to be compared with the phrase.
    Equal passages count once.
    """
    phrases = staged(passages.select(T.exact_phrase(F.col("text"), None).alias("phrase")).where(F.col("phrase") != "").distinct()
                     .select("phrase", F.split("phrase", " ").alias("w")).select("phrase", F.size("w").alias("size"), "w", F.monotonically_increasing_id().alias("number")))
    own = F.when(F.col("size") >= LEAST_WORDS[0], 0).when(F.col("size") >= LEAST_WORDS[1], 1).otherwise(2)
    firsts = winnowed(phrases, "number", "w", [0, 1, 2]).join(phrases.select("number", own.alias("level")), ["number", "level"])
    firsts = firsts.groupBy("number", "level").agg(F.min_by(F.struct("anchor", F.col("place").alias("offset")), "place").alias("a"))
    wanted = staged(firsts.select("number", "level", "a.*"))
    levels = sorted(r["level"] for r in wanted.select("level").distinct().collect())  # three at most
    body = T.clean(F.regexp_replace("text", "[\"“”„«»]", " "))
    with_words = lambda rows: rows.select("doc_id", F.split(body, " ").alias("w"))
    if not levels:
        return documents.select(F.lit("").alias("phrase"), "doc_id").limit(0)
    kept = winnowed(with_words(documents), "doc_id", "w", levels)
    # One word may stand in every document: only those anchors are counted and salted before they meet.
    met = lookup_join(staged(kept), wanted, ["level", "anchor"], "inner") if levels[-1] == 2 else kept.join(wanted, ["level", "anchor"])
    met = staged(met.select(F.col("doc_id").alias("in"), (F.col("place") - F.col("offset") + 1).alias("from"), "number").where("from > 0"))
    hit = with_words(documents.join(met.select("in").distinct(), F.col("doc_id") == F.col("in"), "left_semi"))
    met = lookup_join(met, phrases.select("number", "size", "phrase"), ["number"], "inner")
    found = hit.join(met, F.col("doc_id") == F.col("in")).where(F.array_join(F.slice("w", F.col("from"), F.col("size")), " ") == F.col("phrase"))
    return found.select("phrase", "doc_id").distinct()


def passage_copy_counts(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, copies): documents that hold each passage, zero included."""
    counts = passage_copies(passages, documents).groupBy("phrase").agg(F.count("*").alias("n"))
    items = passages.select("item_id", T.exact_phrase(F.col("text"), None).alias("phrase"))
    return lookup_join(items, counts, ["phrase"]).select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("copies"))
