"""Typed page records from raw markup.

``page_records`` turns one page row into one record row: scalars plus one array
column per kind of child. Everything is computed inside the row, so the stage has
no shuffle, columns nobody reads are pruned, and a host that owns a third of the
crawl is spread like any other. ``children`` explodes one array into a child table.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, text as T, urls as U
from .skew import staged

# The reference collector's limits, applied only on request.
COLLECTOR_LIMITS = {
    "children": 5000, "script_chars": 200_000, "scripts_chars": 2_000_000, "scripts": 500,
    "noscript": 100, "noscript_chars": 20_000, "iframes": 200, "url_chars": 2000,
    "microdata_roots": 200, "rdfa": 200, "generators": 20, "asset_links": 500, "feeds": 5, "rest_links": 3,
    "comments_first": 250, "comments_last": 50, "body_class": 3000, "attribute_elements": 3000,
    "comment_chars": 400, "attr_chars": 400, "attrs_chars": 1500, "generator_chars": 300, "feed_title_chars": 120, "marker_chars": 60,
}

_OG_FAMILY = r"(?i)^(?:og|article|fb|book|profile|product|music|video):"
_WORD = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
_ASSET_REL = r"(?:^|\s)(?:stylesheet|preload|modulepreload|prefetch)(?:\s|\z)"
_HTMX = r"(?i)\shx-(?:get|post|put|patch|delete|target|swap|trigger|boost)(?=[\s/>=])"


_CACHE: dict = {}


def _shared(key, build) -> Column:
    """Build an expression once per context: records differ in columns, not in expressions."""
    context = SparkContext._active_spark_context
    if _CACHE.get("context") is not context:
        _CACHE.clear()
        _CACHE["context"] = context
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def _rel_has(rel: Column, token: str) -> Column:
    return F.array_contains(F.split(F.lower(F.coalesce(rel, F.lit(""))), r"\s+"), token)


def _first(arr: Column, cond) -> Column:
    return F.get(F.filter(arr, cond), F.lit(0))


def _cap(arr: Column, n: int | None) -> Column:
    return arr if n is None else F.slice(arr, 1, n)


def _left(s: Column, n: int | None) -> Column:
    return s if n is None else F.left(s, F.lit(n))


def _group(parts: Column, base: Column, text: bool = False) -> Column:
    """Parse captured elements once: tag, attribute map, resolved address, text."""
    plain = F.transform(
        parts, lambda p: F.struct(H.tag_name(p).alias("tag"), H.attributes(p).alias("attrs"), p.alias("part"))
    )

    def element(e: Column) -> Column:
        at = e["attrs"]
        ref = (
            F.when(e["tag"].isin("a", "area", "link"), at["href"])
            .when(e["tag"] == "img", F.coalesce(at["src"], at["data-src"]))
            .otherwise(at["src"])
        )
        extra = [H.text_of(H.inner(e["part"])).alias("text")] if text else []
        return F.struct(e["tag"].alias("tag"), at.alias("attrs"), U.resolve(ref, base).alias("url"), e["part"].alias("part"), *extra)

    return F.transform(plain, element)


def parse(pages: DataFrame) -> DataFrame:
    """Add the shared intermediate columns every extractor reads.

    Elements come in four groups (head-like tags, raw-text elements, anchors,
    headings), each parsed by one expression; groups nobody reads are pruned.
    """
    html, doc, base = F.col("html"), F.col("_doc"), F.col("_base")
    df = pages.withColumns({
        "_raw": _shared("_raw", lambda: H.raw_parts(html)), "_doc": _shared("_doc", lambda: H.masked(html)),
    })

    def base_href():
        return H.attr(_first(H.start_tags(doc, "base"), lambda t: H.has_attr(t, "href")), "href")

    def effective_base():
        based = U.base_parts(U.resolve(F.col("_base_href"), F.col("_page")))
        return F.when(F.col("_base_href").isNull(), F.col("_page")).otherwise(based)

    df = df.withColumns({
        "_page": _shared("_page", lambda: U.base_parts(U.normalize(F.col("url")))), "_base_href": _shared("_base_href", base_href),
    })
    df = df.withColumn("_base", _shared("_base", effective_base))
    is_code = lambda r: H.is_tag(r, "script|iframe")
    anchors = lambda: H.elements_with_content(doc, "a", r"</?a(?=[\s/>])", alone="area")
    return df.withColumns({
        "_tags": _shared("_tags", lambda: _group(H.start_tags(doc, "meta|link|html|body|img"), base)),
        "_code": _shared("_code", lambda: _group(F.filter(F.col("_raw"), is_code), base)),
        "_anchors": _shared("_anchors", lambda: _group(anchors(), base, text=True)),
    })


def _tagged(*names: str) -> Column:
    return F.filter(F.col("_tags"), lambda t: t["tag"].isin(*names))


def _head() -> Column:
    base = F.col("_base")
    metas, links = F.col("_metas"), F.col("_links")

    def named(name):
        return F.filter(metas, lambda m: m["name"] == name)

    def meta(name):
        m = F.get(named(name), F.lit(0))
        return F.when(m.isNotNull(), F.coalesce(m["attrs"]["content"], F.lit("")))

    def rel_href(token):
        return _first(links, lambda l: _rel_has(l["attrs"]["rel"], token))["url"]

    equiv = lambda name: _first(metas, lambda m: F.lower(m["attrs"]["http-equiv"]) == name)["attrs"]["content"]
    parts = F.when(F.col("html").rlike(r"(?i)<svg[\s>]"), H.raw_parts(H.without_svg(F.col("html")))).otherwise(F.col("_raw"))
    titles = F.filter(parts, lambda r: H.is_tag(r, "title"))
    html_attrs = F.get(_tagged("html"), F.lit(0))["attrs"]
    charset = F.coalesce(
        _first(metas, lambda m: m["attrs"]["charset"].isNotNull())["attrs"]["charset"],
        T.blank_to_null(F.regexp_extract(equiv("content-type"), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1)),
    )
    canonicals = F.transform(
        F.filter(links, lambda l: _rel_has(l["attrs"]["rel"], "canonical")),
        lambda l: F.struct(l["url"].alias("href"), l["attrs"]["href"].alias("raw")),
    )
    return F.struct(
        F.when(F.size(titles) > 0, T.clean(T.decode_entities(H.raw_text(F.get(titles, F.lit(0)))))).alias("title"),
        F.size(titles).alias("title_count"),
        meta("description").alias("description"),
        F.size(named("description")).alias("description_count"),
        meta("robots").alias("robots"),
        F.size(named("robots")).alias("robots_count"),
        meta("googlebot").alias("googlebot"),
        meta("keywords").alias("keywords"),
        meta("author").alias("author"),
        meta("generator").alias("generator"),
        meta("viewport").alias("viewport"),
        meta("theme-color").alias("theme_color"),
        charset.alias("charset"),
        html_attrs["lang"].alias("lang"),
        html_attrs["dir"].alias("dir"),
        canonicals.alias("canonicals"),
        F.coalesce(rel_href("icon"), F.concat(base["origin"], F.lit("/favicon.ico"))).alias("favicon"),
        rel_href("amphtml").alias("amphtml"),
        rel_href("prev").alias("prev"),
        rel_href("next").alias("next"),
        equiv("refresh").alias("meta_refresh"),
        F.col("_base_href").alias("base"),
    )


def _headings() -> Column:
    parts = H.elements_with_content(F.col("_doc"), "h[1-6]", r"</?h[1-6](?=[\s/>])")
    return F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("idx"), F.substring(p, 3, 1).cast("int").alias("level"), H.text_of(H.inner(p)).alias("text")
        ),
    )


def _anchor_rows() -> Column:
    def link(e: Column, i: Column) -> Column:
        at = e["attrs"]
        img = _first(H.start_tags(e["part"], "img"), lambda t: H.has_attr(t, "alt"))
        alt = F.when(e["part"].rlike(r"(?i)<img[\s/]"), T.clean(H.attr(img, "alt"))).otherwise("")
        label = T.clean(F.coalesce(T.blank_to_null(at["aria-label"]), at["title"]))
        best = (
            F.when(e["text"] != "", F.struct(e["text"].alias("t"), F.lit("text").alias("s")))
            .when(alt != "", F.struct(alt.alias("t"), F.lit("image alt").alias("s")))
            .when(label != "", F.struct(label.alias("t"), F.lit("label").alias("s")))
            .otherwise(F.struct(F.lit("").alias("t"), F.lit("text").alias("s")))
        )
        return F.struct(
            i.alias("idx"), e["url"].alias("href"), at["href"].alias("raw"), best.alias("best"),
            F.lower(T.clean(at["rel"])).alias("rel"), F.coalesce(at["target"], F.lit("")).alias("target"),
        )

    rows = F.transform(F.filter(F.col("_anchors"), lambda e: e["attrs"]["href"].isNotNull()), link)
    return F.transform(
        rows,
        lambda l: F.struct(
            l["idx"].alias("idx"), l["href"].alias("href"), l["raw"].alias("raw"), l["best"]["t"].alias("text"),
            l["best"]["s"].alias("text_source"), l["rel"].alias("rel"), l["target"].alias("target"),
        ),
    )


def _images() -> Column:
    def image(e: Column, i: Column) -> Column:
        at = e["attrs"]
        return F.struct(
            i.alias("idx"), e["url"].alias("src"),
            F.coalesce(T.blank_to_null(at["src"]), at["data-src"], F.lit("")).alias("raw"),
            at["alt"].alias("alt"), at["title"].alias("title"),
            F.coalesce(at["loading"], F.lit("")).alias("loading"),
            (F.coalesce(at["srcset"], F.lit("")) != "").alias("srcset"),
        )

    return F.transform(_tagged("img"), image)


def _running_cut(texts: Column, total: int) -> Column:
    """Keep leading text until ``total`` characters are used up."""
    state = F.aggregate(
        texts,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
        lambda acc, t: F.struct(
            (acc["n"] + F.least(F.length(t), F.lit(total) - acc["n"])).alias("n"),
            F.concat(acc["out"], F.array(F.left(t, F.lit(total) - acc["n"]))).alias("out"),
        ),
    )
    return F.filter(state["out"], lambda t: t != "")


# Columns of a page record, in order; each is built only when asked for.
RECORD_COLUMNS = (
    "head", "word_count", "headings", "links", "images", "jsonld", "rdfa_types", "hreflang", "og", "twitter",
    "scripts", "inline", "noscript", "iframes", "generators", "asset_links", "feeds", "rest_links", "comments",
    "body_class", "dom", "base",
)
SIGNAL_COLUMNS = (
    "scripts", "inline", "noscript", "iframes", "generators", "asset_links", "feeds", "rest_links", "comments",
    "body_class", "dom",
)


def page_records(pages: DataFrame, *only: str, limits: dict | None = None) -> DataFrame:
    """One record per page: the named columns of RECORD_COLUMNS, all by default.

    ``limits`` (see COLLECTOR_LIMITS) caps the collections; without it whole pages are read.
    """
    cap = (limits or {}).get
    builders = _builders(cap)
    named_metas = lambda: F.transform(
        _tagged("meta"), lambda m: F.struct(F.lower(T.strip(m["attrs"]["name"])).alias("name"), m["attrs"].alias("attrs"))
    )
    code_scripts = lambda: F.filter(F.col("_code"), lambda e: (e["tag"] == "script") & ~_script_type(e).isin(_DATA_SCRIPTS))
    df = parse(pages).withColumns({
        "_metas": _shared("_metas", named_metas), "_links": _shared("_links", lambda: _tagged("link")),
        "_scripts": _shared("_scripts", code_scripts),
    })
    names = only or RECORD_COLUMNS
    key = tuple(sorted((limits or {}).items()))
    fields = [_shared((n, key), builders[n]).alias(n) for n in names]
    # One generated row per page. It changes nothing in the result, but a filter on a record column
    # stops here instead of being rewritten into a second copy of the whole extraction.
    out = df.select(*[c for c in pages.columns if c != "html"], F.inline_outer(F.array(F.struct(*fields))))
    for name in ("headings", "links", "images"):
        if name in names:
            out = out.withColumn(f"{name}_total", F.size(name))
            if cap("children") is not None:
                out = out.withColumn(name, _cap(F.col(name), cap("children")))
    return out


# Script types that hold data, not code.
_DATA_SCRIPTS = ["application/ld+json", "importmap", "speculationrules"]


def _script_type(e: Column) -> Column:
    return F.lower(F.trim(F.coalesce(e["attrs"]["type"], F.lit(""))))


def _builders(cap) -> dict:
    code, raw, doc = F.col("_code"), F.col("_raw"), F.col("_doc")
    metas, links, scripts = F.col("_metas"), F.col("_links"), F.col("_scripts")
    rel_of = lambda l: F.lower(F.trim(F.coalesce(l["attrs"]["rel"], F.lit(""))))
    with_href = lambda: F.filter(links, lambda l: l["attrs"]["href"].isNotNull())
    url_of = lambda l: _left(l["url"], cap("url_chars"))
    pair = lambda key, m: F.struct(key.alias("key"), F.coalesce(m["attrs"]["content"], F.lit("")).alias("value"))

    def inline():
        own = F.filter(scripts, lambda e: e["attrs"]["src"].isNull())
        texts = F.transform(own, lambda e: _left(H.raw_text(e["part"]), cap("script_chars")))
        texts = F.filter(texts, lambda t: t.rlike(r"(?U)\S"))
        return texts if cap("scripts_chars") is None else _running_cut(texts, cap("scripts_chars"))

    def script_tags():
        def attr_text(attrs: Column) -> Column:
            pairs = F.filter(F.map_entries(attrs), lambda x: x["key"] != "src")
            shown = lambda x: F.concat(F.lit(" "), x["key"], F.lit('="'), _left(x["value"], cap("attr_chars")), F.lit('"'))
            return _left(F.array_join(F.transform(pairs, shown), ""), cap("attrs_chars"))

        found = F.transform(
            F.filter(scripts, lambda e: e["attrs"]["src"].isNotNull()),
            lambda e: F.struct(url_of(e).alias("src"), attr_text(e["attrs"]).alias("attrs")),
        )
        return _cap(found, cap("scripts"))

    def noscript():
        found = _cap(F.filter(raw, lambda r: H.is_tag(r, "noscript")), cap("noscript"))
        return F.transform(found, lambda r: _left(H.raw_text(r), cap("noscript_chars")))

    def iframes():
        found = F.filter(code, lambda e: (e["tag"] == "iframe") & e["attrs"]["src"].isNotNull())
        return F.transform(_cap(found, cap("iframes")), url_of)

    def comments():
        found = F.transform(
            F.filter(raw, lambda r: r.startswith("<!--")),
            lambda r: _left(T.strip(F.regexp_replace(r, r"(?s)^<!--|-->\z", "")), cap("comment_chars")),
        )
        found = F.filter(found, lambda c: c != "")
        if cap("comments_first") is None:
            return found
        first, last = cap("comments_first"), cap("comments_last")
        tail = F.slice(found, first + 1, F.greatest(F.size(found) - first, F.lit(1)))
        return F.concat(
            F.slice(found, 1, first), F.slice(tail, F.greatest(F.size(tail) - last + 1, F.lit(1)), F.lit(last))
        )

    def og():
        family = F.filter(metas, lambda m: m["attrs"]["property"].rlike(_OG_FAMILY))
        return F.transform(family, lambda m: pair(m["attrs"]["property"], m))

    def twitter():
        is_tw = lambda s: F.coalesce(F.lower(s).startswith("twitter:"), F.lit(False))
        family = F.filter(metas, lambda m: is_tw(m["attrs"]["name"]) | is_tw(m["attrs"]["property"]))
        key = lambda m: F.lower(F.coalesce(T.blank_to_null(m["attrs"]["name"]), m["attrs"]["property"]))
        return F.transform(family, lambda m: pair(key(m), m))

    def hreflang():
        found = F.filter(links, lambda l: _rel_has(l["attrs"]["rel"], "alternate") & l["attrs"]["hreflang"].isNotNull())
        return F.transform(
            found,
            lambda l: F.struct(
                T.clean(l["attrs"]["hreflang"]).alias("lang"), l["url"].alias("href"), l["attrs"]["href"].alias("raw")
            ),
        )

    def rdfa():
        typed = _cap(F.filter(H.start_tags(doc), lambda t: H.has_attr(t, "typeof")), cap("rdfa"))
        types = F.filter(F.transform(typed, lambda t: T.clean(H.attr(t, "typeof"))), lambda t: t != "")
        return F.when(doc.rlike(r"(?i)\stypeof[\s=>]"), types).otherwise(F.array().cast("array<string>"))

    def generators():
        found = _cap(F.filter(metas, lambda m: F.lower(m["attrs"]["name"]) == "generator"), cap("generators"))
        texts = F.transform(found, lambda m: F.trim(_left(F.coalesce(m["attrs"]["content"], F.lit("")), cap("generator_chars"))))
        return F.filter(texts, lambda g: g != "")

    def asset_links():
        return F.transform(_cap(F.filter(with_href(), lambda l: rel_of(l).rlike(_ASSET_REL)), cap("asset_links")), url_of)

    def feeds():
        is_feed = lambda l: (
            rel_of(l).rlike(r"(?:^|\s)alternate(?:\s|\z)") & ~rel_of(l).rlike(_ASSET_REL)
            & F.coalesce(l["attrs"]["type"], F.lit("")).rlike(r"(?i)(?:rss|atom)\+xml")
        )
        title = lambda l: _left(F.coalesce(l["attrs"]["title"], F.lit("")), cap("feed_title_chars"))
        found = _cap(F.filter(with_href(), is_feed), cap("feeds"))
        return F.transform(found, lambda l: F.struct(url_of(l).alias("href"), title(l).alias("title")))

    def rest_links():
        return F.transform(_cap(F.filter(with_href(), lambda l: rel_of(l) == "https://api.w.org/"), cap("rest_links")), url_of)

    def jsonld():
        found = F.filter(code, lambda e: F.lower(e["attrs"]["type"]) == "application/ld+json")
        return F.transform(found, lambda e: H.raw_text(e["part"]))

    def body_class():
        return _left(F.coalesce(F.get(_tagged("body"), F.lit(0))["attrs"]["class"], F.lit("")), cap("body_class"))

    return {
        "head": _head,
        "word_count": lambda: F.regexp_count(H.untagged(H.body_of(doc)), F.lit(_WORD)),
        "headings": _headings, "links": _anchor_rows, "images": _images, "jsonld": jsonld, "rdfa_types": rdfa,
        "hreflang": hreflang, "og": og, "twitter": twitter, "scripts": script_tags, "inline": inline,
        "noscript": noscript, "iframes": iframes, "generators": generators, "asset_links": asset_links,
        "feeds": feeds, "rest_links": rest_links, "comments": comments, "body_class": body_class,
        "dom": lambda: _dom_markers(cap("attribute_elements"), cap("marker_chars")), "base": lambda: F.col("_base"),
    }


def _dom_markers(limit: int | None, chars: int | None) -> Column:
    """Framework markers in the markup, as (key, value) rows ('true' for flags)."""
    doc = F.col("_doc")
    tags, some = H.start_tags(doc), _cap(H.start_tags(doc), limit)

    def flag(pattern, among=tags):
        # The cheap whole-page test first; then names are tested on tags alone, never on text.
        return F.when(doc.rlike(pattern), F.when(F.exists(among, lambda t: t.rlike(pattern)), "true"))

    has_id = lambda name: flag(rf"(?i)\sid\s*=\s*[\"']?(?-i:{name})(?=[\"'\s>])")
    ng = r"(?i)\sng-version\s*=\s*[\"']?([^\"'\s>]*)"
    islands = F.regexp_count(doc, F.lit(r"(?i)<astro-island[\s/>]"))
    html_attrs = F.get(_tagged("html"), F.lit(0))["attrs"]
    # Marker keys and what they stand for.
    markers = {
        "ngVersion": F.when(doc.rlike(ng), _left(F.regexp_extract(_first(tags, lambda t: t.rlike(ng)), ng, 1), chars)),
        "wfSite": _left(T.blank_to_null(html_attrs["data-wf-site"]), chars),
        "nuxtRoot": has_id("__nuxt"),
        "nuxtData": has_id("__NUXT_DATA__"),
        "nextData": has_id("__NEXT_DATA__"),
        "gatsbyRoot": has_id("___gatsby"),
        "astroIsland": F.when(islands > 0, islands.cast("string")),
        "vueApp": flag(r"(?i)\sdata-v-app(?=[\s/>=])"),
        "reactRoot": flag(r"(?i)\sdata-reactroot(?=[\s/>=])"),
        "restLink": F.when(F.exists(F.col("_links"), lambda l: F.coalesce(l["attrs"]["rel"] == "https://api.w.org/", F.lit(False))), "true"),
        "astroCid": flag(r"(?i)\sdata-astro-cid", some),
        "svelteKitAttr": flag(r"(?i)\sdata-sveltekit-", some),
        "htmxAttr": flag(_HTMX, some),
        "alpineAttr": flag(r"(?i)\sx-data(?=[\s/>=])", some),
    }
    # Most pages carry no marker: plain substring tests first.
    tokens = [
        "__nuxt", "__next", "___gatsby", "ng-version", "astro-", "data-wf-site", "data-v-app", "data-reactroot",
        "data-sveltekit-", "api.w.org", "hx-", "x-data",
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in markers.items()])
    found = F.filter(entries, lambda e: e["value"].isNotNull())
    seen = T.let(F.lower(doc), lambda d: reduce(lambda a, b: a | b, [d.contains(t) for t in tokens]))
    return F.when(seen, found).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def elements(pages: DataFrame) -> DataFrame:
    """Element table (S2): one row per start tag, in document order."""
    markup = F.col("markup")
    df = parse(pages).select("page_id", F.posexplode_outer(H.start_tags(F.col("_doc"))).alias("pos", "markup"))
    return df.where(markup.isNotNull()).select(
        "page_id", "pos", H.tag_name(markup).alias("tag"), _shared("attrs", lambda: H.attributes(markup)).alias("attrs")
    )


def children(records: DataFrame, name: str, *keep: str) -> DataFrame:
    """Explode one array of the page record into a child table."""
    df = records.select("page_id", *keep, F.posexplode_outer(name).alias("_i", "_c")).where(F.col("_c").isNotNull())
    kind = records.schema[name].dataType.elementType
    if kind.typeName() != "struct":
        return df.select("page_id", *keep, F.col("_i").alias("idx"), F.col("_c").alias("value"))
    fields = [f.name for f in kind.fields]
    lead = [] if "idx" in fields else [F.col("_i").alias("idx")]
    return df.select("page_id", *keep, *lead, *[F.col(f"_c.{f}").alias(f) for f in fields])


def with_boxes(child: DataFrame, boxes: DataFrame, tag: str) -> DataFrame:
    """Attach rendered sizes and visibility from the optional ``render_boxes`` table."""
    b = boxes.where(F.col("tag") == tag).drop("tag")
    return child.join(b, ["page_id", "idx"], "left")


def staged_signals(pages: DataFrame, limits: dict | None = None) -> DataFrame:
    """Signals of a crawl, extracted once and stored by kind for the stages that read them."""
    return staged(signals(page_records(pages, *SIGNAL_COLUMNS, limits=limits)), "kind")


def signals(records: DataFrame) -> DataFrame:
    """Code signals in long form: (page_id, kind, seq, key, value)."""
    def as_rows(kind, col, key=lambda x: F.lit(None).cast("string"), value=lambda x: x):
        return F.transform(col, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("seq"), key(x).alias("key"), value(x).alias("value")))

    c = F.col
    allrows = F.concat(
        as_rows("script", c("scripts"), lambda x: x["attrs"], lambda x: x["src"]),
        as_rows("inline", c("inline")),
        as_rows("noscript", c("noscript")),
        as_rows("iframe", c("iframes")),
        as_rows("generator", c("generators")),
        as_rows("link", c("asset_links")),
        as_rows("feed", c("feeds"), lambda x: x["title"], lambda x: x["href"]),
        as_rows("rest", c("rest_links")),
        as_rows("comment", c("comments")),
        as_rows("body", F.filter(F.array(c("body_class")), lambda x: x != "")),
        as_rows("dom", c("dom"), lambda x: x["key"], lambda x: x["value"]),
    )
    return records.select("page_id", F.explode_outer(allrows).alias("s")).where(F.col("s").isNotNull()).select("page_id", "s.*")
