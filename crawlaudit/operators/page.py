"""Per-page verdicts and statistics (A1-A15, A22-A26), all inside the record row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import directives as D, text as T, urls as U

# Recommended social tags, in report order.
OG_RECOMMENDED = ["og:title", "og:description", "og:image", "og:url", "og:type"]
HREFLANG_CODE = r"(?i)^(?:x-default|[a-z]{2,3}(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?)\z"
MAX_URL = 115


def _count(arr: Column, cond) -> Column:
    return F.size(F.filter(arr, cond))


# ---- canonical and indexability


def canonical_status(canonicals: Column, page_url: Column) -> Column:
    """missing, empty, self, other or conflict (A1)."""

    # Record addresses are serialised already; only the page's own needs it.
    def decide(c: Column) -> Column:
        href = F.get(c, F.lit(0))["href"]
        distinct = F.size(F.array_distinct(F.transform(c, lambda x: U.strip_hash_text(x["href"]))))
        return (
            F.when(F.size(c) < 1, "missing")
            .when((F.size(c) > 1) & (distinct > 1), "conflict")
            .when(href == "", "empty")
            .when(U.strip_hash_text(href) == U.strip_hash(page_url), "self")
            .otherwise("other")
        )

    return T.let(F.coalesce(canonicals, F.array().cast("array<struct<href:string,raw:string>>")), decide)


def meta_directives(head: Column) -> Column:
    """Robots directives of the robots and googlebot metas together."""
    return F.concat(D.directives_for(head["robots"]), D.directives_for(head["googlebot"]))


def indexability(head: Column, page_url: Column, http: Column, robots_allowed: Column, robots_known: Column) -> Column:
    """struct(indexable, reasons, unknown): a missing source is unknown, never a block (A5).

    ``http`` is struct(status, x_robots_tag, final_url) or NULL.
    """
    status = http["status"]
    canonical = canonical_status(head["canonicals"], F.coalesce(T.blank_to_null(http["final_url"]), page_url))
    reasons = F.array_compact(F.array(
        F.when(D.has_noindex(meta_directives(head)), "noindex in meta robots"),
        F.when((status < 200) | (status >= 300), F.concat(F.lit("HTTP status "), status.cast("string"))),
        F.when(D.has_noindex(D.directives_for(http["x_robots_tag"])), "noindex in X-Robots-Tag header"),
        F.when(robots_known & ~robots_allowed, "blocked by robots.txt"),
        F.when(canonical == "other", "canonical points to another URL").when(canonical == "conflict", "conflicting canonical tags"),
        F.when(F.coalesce(head["meta_refresh"], F.lit("")) != "", "meta refresh redirect"),
    ))
    unknown = F.array_compact(F.array(F.when(http.isNull(), "HTTP headers"), F.when(~robots_known, "robots.txt")))
    pack = lambda r: F.struct((F.size(r) == 0).alias("indexable"), r.alias("reasons"), unknown.alias("unknown"))
    return T.let(reasons, pack)


# ---- headings


def heading_issues(headings: Column) -> Column:
    """array<struct<level, text, idx>>: missing or repeated H1, skips, empty."""
    issue = lambda level, text, idx=None: F.struct(
        F.lit(level).alias("level"), text.alias("text"), (F.lit(None) if idx is None else idx).cast("int").alias("idx")
    )
    h1 = _count(headings, lambda h: h["level"] == 1)
    empty = _count(headings, lambda h: h["text"] == "")
    pairs = F.transform(
        headings,
        lambda h, i: F.struct(h["level"].alias("level"), h["idx"].alias("idx"), F.get(headings, i - 1)["level"].alias("prev")),
    )
    skips = F.transform(
        F.filter(pairs, lambda p: p["level"] > p["prev"] + 1),
        lambda p: issue("warn", F.concat(F.lit("Skips from H"), p["prev"].cast("string"), F.lit(" to H"), p["level"].cast("string")), p["idx"]),
    )
    lead = F.when(h1 == 0, issue("error", F.lit("No H1 on the page"))).when(
        h1 > 1, issue("warn", F.concat(h1.cast("string"), F.lit(" H1 tags")))
    )
    tail = F.when(
        empty > 0, issue("warn", F.concat(empty.cast("string"), F.when(empty > 1, " empty headings").otherwise(" empty heading")))
    )
    return F.array_compact(F.concat(F.array(lead), skips, F.array(tail)))


def heading_counts(headings: Column) -> list[Column]:
    """h1..h6 counts as six columns."""
    at = lambda n: _count(headings, lambda h: h["level"] == n)
    return [at(n).alias(f"h{n}") for n in range(1, 7)]


# ---- links


def link_kind(raw: Column, href: Column, page_host: Column) -> Column:
    """javascript, mailto, tel, fragment, internal, external or other."""
    r = T.strip(F.coalesce(raw, F.lit("")))
    return (
        F.when(r.rlike("(?i)^javascript:"), "javascript")
        .when(r.rlike("(?i)^mailto:"), "mailto")
        .when(r.rlike("(?i)^tel:"), "tel")
        .when(r.startswith("#"), "fragment")
        .when(href.rlike(r"(?i)^https?://[^/?#]") & (U.bare_host(href) == page_host), "internal")
        .when(href.rlike(r"(?i)^https?://[^/?#]"), "external")
        .otherwise("other")
    )


def classify_links(records: DataFrame) -> DataFrame:
    """Add kind and rel flags to every link of the record."""
    has = lambda l, t: F.array_contains(F.split(l["rel"], r"\s+"), t)
    flags = lambda l: [has(l, t).alias(t) for t in ("nofollow", "ugc", "sponsored")]
    fields = ("idx", "href", "raw", "text", "text_source", "rel", "target")
    rows = F.transform(
        F.col("links"),
        lambda l: F.struct(
            *[l[f].alias(f) for f in fields], link_kind(l["raw"], l["href"], F.col("_host")).alias("kind"), *flags(l),
            (has(l, "nofollow") | has(l, "ugc") | has(l, "sponsored")).alias("qualified"),
        ),
    )
    return records.withColumn("_host", U.bare_host(F.col("url"))).withColumn("links", rows).drop("_host")


def link_stats(links: Column) -> Column:
    """total, unique, internal, external, nofollow, other, no_text of classified links."""
    web = lambda l: l["kind"].isin("internal", "external")
    return F.struct(
        F.size(links).alias("total"),
        F.size(F.array_distinct(F.transform(links, lambda l: l["href"]))).alias("unique"),
        _count(links, lambda l: l["kind"] == "internal").alias("internal"),
        _count(links, lambda l: l["kind"] == "external").alias("external"),
        _count(links, lambda l: l["qualified"]).alias("nofollow"),
        _count(links, lambda l: ~web(l)).alias("other"),
        _count(links, lambda l: (l["text"] == "") & web(l)).alias("no_text"),
    )


def filter_links(links: DataFrame, which: str = "all", query: str = "") -> DataFrame:
    """Links of one filter whose address or anchor holds the query."""
    kinds = {
        "all": F.lit(True), "internal": F.col("kind") == "internal", "external": F.col("kind") == "external",
        "nofollow": F.col("qualified"), "other": ~F.col("kind").isin("internal", "external"),
    }
    q = query.strip().lower()
    hit = F.lower("href").contains(q) | F.lower("text").contains(q) if q else F.lit(True)
    return links.where(kinds[which] & hit)


# ---- images


def image_flags(images: DataFrame) -> DataFrame:
    """missing_alt, empty_alt, missing_title, lazy, oversized per image row.

    ``width`` and ``shown_width`` come from the optional boxes table; without it nothing is oversized.
    """
    width = F.col("width") if "width" in images.columns else F.lit(None).cast("int")
    shown = F.col("shown_width") if "shown_width" in images.columns else F.lit(None).cast("int")
    return images.withColumns({
        "missing_alt": F.col("alt").isNull(),
        "empty_alt": F.coalesce(~F.col("alt").rlike(r"(?U)\S"), F.lit(False)),
        "missing_title": F.coalesce(F.col("title"), F.lit("")) == "",
        "lazy": F.col("loading") == "lazy",
        "oversized": F.coalesce((shown > 0) & (width > 2 * shown) & (width - shown > 300), F.lit(False)),
    })


def image_stats(images: Column) -> Column:
    """Counts of the markup-only flags, inside the record."""
    return F.struct(
        F.size(images).alias("total"),
        _count(images, lambda i: i["alt"].isNull()).alias("missing_alt"),
        _count(images, lambda i: F.coalesce(~i["alt"].rlike(r"(?U)\S"), F.lit(False))).alias("empty_alt"),
        _count(images, lambda i: F.coalesce(i["title"], F.lit("")) == "").alias("missing_title"),
        _count(images, lambda i: i["loading"] == "lazy").alias("lazy"),
    )


def image_stats_by_page(flagged: DataFrame) -> DataFrame:
    """Counts per page including oversized images."""
    flags = ("missing_alt", "empty_alt", "missing_title", "lazy", "oversized")
    return flagged.groupBy("page_id").agg(F.count("*").alias("total"), *[F.count_if(f).alias(f) for f in flags])


def filter_images(flagged: DataFrame, which: str = "all") -> DataFrame:
    """Images of one filter: all, missing, empty or oversized."""
    conds = {"all": F.lit(True), "missing": F.col("missing_alt"), "empty": F.col("empty_alt"), "oversized": F.col("oversized")}
    return flagged.where(conds[which])


# ---- hreflang sets


def valid_hreflang(code: Column) -> Column:
    """x-default or language[-Script][-REGION]."""
    return code.rlike(HREFLANG_CODE)


def hreflang_issues(entries: Column, page_url: Column) -> Column:
    """array<struct<level, text>> over one page's alternates."""
    issue = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("text"))
    langs = F.transform(entries, lambda e: F.lower(e["lang"]))
    page = U.strip_hash(page_url)
    per_entry = F.flatten(F.transform(
        entries,
        lambda e: F.array(
            F.when(~valid_hreflang(e["lang"]), issue("error", F.concat(F.lit('Invalid code "'), e["lang"], F.lit('"')))),
            F.when(
                (F.coalesce(e["raw"], F.lit("")) != "") & ~T.strip(e["raw"]).rlike("(?i)^https?://"),
                issue("warn", F.concat(F.lit("Relative URL for "), e["lang"])),
            ),
        ),
    ))
    repeats = F.transform(
        F.array_distinct(langs), lambda l: F.struct(l.alias("lang"), _count(langs, lambda x: x == l).alias("n"))
    )
    dup = F.transform(
        F.filter(repeats, lambda r: r["n"] > 1),
        lambda r: issue("error", F.concat(F.lit('"'), r["lang"], F.lit('" listed '), r["n"].cast("string"), F.lit(" times"))),
    )
    lead = F.array(
        F.when(~F.array_contains(langs, "x-default"), issue("warn", F.lit("No x-default"))),
        F.when(~F.exists(entries, lambda e: U.strip_hash_text(e["href"]) == page), issue("warn", F.lit("No self-referencing hreflang"))),
    )
    none = F.array().cast("array<struct<level:string,text:string>>")
    return F.when(F.size(entries) == 0, none).otherwise(F.array_compact(F.concat(lead, per_entry, dup)))


# ---- social


def first_value(pairs: Column, key: str) -> Column:
    """First value of a key, case-insensitive; NULL when absent."""
    return F.get(F.filter(pairs, lambda p: F.lower(p["key"]) == key), F.lit(0))["value"]


def missing_social(og: Column, twitter: Column) -> Column:
    """Recommended social tags a page lacks, in order."""
    have = F.transform(og, lambda p: F.lower(p["key"]))
    missing = F.filter(F.array(*[F.lit(k) for k in OG_RECOMMENDED]), lambda k: ~F.array_contains(have, k))
    card = F.exists(twitter, lambda p: p["key"] == "twitter:card")
    return F.concat(missing, F.when(card, F.array().cast("array<string>")).otherwise(F.array(F.lit("twitter:card"))))


def social_card(records: DataFrame) -> DataFrame:
    """Resolved previews for both card families."""
    og, tw, head, url = F.col("og"), F.col("twitter"), F.col("head"), F.col("url")
    some = lambda *keys, pairs=og: F.coalesce(*[T.blank_to_null(first_value(pairs, k)) for k in keys])
    absolute = lambda v: F.when(v.isNotNull(), U.resolve(v, F.col("_page")))
    df = records.withColumn("_page", U.base_parts(U.normalize(url))).select(
        "page_id", "url", "head", "og", "twitter",
        first_value(og, "og:title").alias("_ot"), first_value(og, "og:description").alias("_od"),
        absolute(some("og:image", "og:image:url", "og:image:secure_url")).alias("og_image"),
        T.blank_to_null(first_value(og, "og:site_name")).alias("_site"),
        T.blank_to_null(first_value(tw, "twitter:card")).alias("twitter_card"),
        absolute(some("twitter:image", "twitter:image:src", pairs=tw)).alias("_ti"),
    )
    title = lambda v: F.coalesce(T.blank_to_null(v), F.col("head.title"), F.lit(""))
    desc = lambda v: F.coalesce(T.blank_to_null(v), F.col("head.description"), F.lit(""))
    card_title = F.coalesce(first_value(tw, "twitter:title"), F.col("_ot"))
    card_desc = F.coalesce(first_value(tw, "twitter:description"), F.col("_od"))
    image = F.coalesce("_ti", "og_image")
    return df.select(
        "page_id",
        F.coalesce("_site", U.bare_host(F.col("url")), F.lit("")).alias("og_site"),
        title(F.col("_ot")).alias("og_title"), desc(F.col("_od")).alias("og_description"), "og_image",
        "twitter_card", title(card_title).alias("twitter_title"), desc(card_desc).alias("twitter_description"),
        image.alias("twitter_image"),
        F.coalesce(
            (F.col("twitter_card") == "summary_large_image") | (F.col("twitter_card").isNull() & image.isNotNull()), F.lit(False)
        ).alias("large_card"),
    )


def image_size_class(width: Column, height: Column, failed: Column) -> Column:
    """failed, ok, too small or aim for a preview image."""
    return (
        F.when(failed, "failed")
        .when((width >= 1200) & (F.abs(width / height - 1.91) < 0.15), "ok")
        .when(width < 600, "too small")
        .when(width.isNotNull(), "aim for 1200x630")
    )


def page_flags(head: Column, url: Column) -> list[Column]:
    """URL too long, missing language and viewport, refresh, repeated tags."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return [
        (F.length(url) > MAX_URL).alias("url_too_long"),
        blank(head["lang"]).alias("lang_missing"),
        blank(head["viewport"]).alias("viewport_missing"),
        (~blank(head["meta_refresh"])).alias("meta_refresh"),
        (head["title_count"] > 1).alias("multiple_titles"),
        (head["description_count"] > 1).alias("multiple_descriptions"),
    ]
