"""CMS details: content folders, themes, plugins, namespaces, core version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..catalog import tech as C
from ..functions import text as T, urls as U, versions as V
from . import tech as TE
from .skew import bucketed

# Bundled-library folders and file names whose ?ver= is their own.
LIBRARY_DIRS = "vendor|vendors|node_modules|bower_components|third-party"
LIBRARY_NAMES = (
    "font-?awesome|bootstrap|jquery|swiper|slick|owl|fancybox|magnific|lightbox|select2|animate|aos|isotope|"
    "masonry|flickity|splide|glide|lottie|gsap|photoswipe|modernizr|normalize"
)
# Namespaces of the core itself, and paths a fetcher never asks for.
CORE_NAMESPACES = r"^(?:wp/v2|oembed/1\.0|wp-site-health/v1|wp-block-editor/v1|wp-abilities/v1|wp/v[0-9])\z"
FORBIDDEN_PATH = r"(?i)(?:^|/)(?:readme\.(?:txt|html)|license\.txt|wp-login\.php|xmlrpc\.php)\z|/wp-admin(?:/|\z)"
_SLUG = "[A-Za-z0-9._-]+"
_LISTED = r"^[a-z0-9-]+\z"


def is_asset_version(v: Column) -> Column:
    """Dotted numbers that do not start with a year."""
    year = F.regexp_extract(v, r"^(\d+)", 1).try_cast("int").between(1990, 2100)
    return F.coalesce(v.rlike(r"^\d{1,4}(?:\.\d{1,4}){1,3}(?:-[0-9A-Za-z.]+)?\z") & ~F.coalesce(year, F.lit(False)), F.lit(False))


def body_themes(signals: DataFrame) -> DataFrame:
    """(page_id, parent, child): theme slugs the body class names."""
    body = signals.where("kind = 'body'")
    slug = lambda p: T.blank_to_null(F.regexp_extract("value", rf"(?:^|\s){p}-([A-Za-z0-9_-]+)(?=\s|\z)", 1))
    df = body.select("page_id", slug("wp-theme").alias("parent"), slug("wp-child-theme").alias("child"))
    return df.where(F.col("parent").isNotNull() | F.col("child").isNotNull())


def content_dirs(urls: DataFrame, slugs: DataFrame) -> DataFrame:
    """(page_id, dirs): extra content folders found through a body-class theme."""
    both = slugs.select("page_id", F.explode(F.array_compact(F.array("parent", "child"))).alias("slug"))
    j = urls.where(F.col("value").contains("/themes/")).join(both, "page_id")
    j = j.withColumn("dir", F.call_function("regexp_extract", F.col("value"), F.concat(F.lit(r"(?i)/([A-Za-z0-9_.-]+)/themes/"), "slug", F.lit("/")), F.lit(1)))
    first = j.where("dir <> ''").groupBy("page_id", "slug").agg(F.min_by("dir", "seq").alias("dir"))
    return first.groupBy("page_id").agg(F.collect_set("dir").alias("dirs"))


def asset_paths(signals: DataFrame, urls: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """Every plugin and theme file a page's addresses and inline code name.

    (page_id, kind, slug, base, file, ver, matched, ord); ``ver`` is NULL for bundled libraries.
    """
    inline = signals.where("kind = 'inline'").select("page_id", (F.col("seq").cast("long") + 1_000_000_000).alias("seq"), F.replace("value", F.lit("\\/"), F.lit("/")).alias("value"))
    texts = urls.select("page_id", "seq", "value").unionByName(inline)
    texts = texts.where(F.col("value").contains("/plugins/") | F.col("value").contains("/themes/"))
    extra = content_dirs(urls, body_themes(signals) if slugs is None else slugs)
    texts = texts.join(extra, "page_id", "left")
    quoted = F.transform(F.coalesce("dirs", F.array().cast("array<string>")), lambda d: F.regexp_replace(d, r"\.", r"\\."))
    dirs = F.array_join(F.array_distinct(F.concat(F.array(F.lit("wp-content")), quoted)), "|")
    stop = r"""\s"'<>()"""
    tail = rf"""/({_SLUG})/([^{stop}?#\\]*)(?:\?([^{stop}#\\]*))?"""
    pattern = F.concat(F.lit(rf"(https?://[^{stop}]*?)?/(?:"), dirs, F.lit(rf")/(plugins|themes){tail}"))
    rows = texts.withColumn("_re", pattern)
    rows = rows.select("page_id", "seq", "_re", F.posexplode(F.regexp_extract_all("value", F.col("_re"), F.lit(0))).alias("_i", "matched"))
    part = lambda g: F.call_function("regexp_extract", F.col("matched"), F.col("_re"), F.lit(g))
    rows = rows.select(
        "page_id", "matched", F.struct("seq", "_i").alias("ord"), T.blank_to_null(part(1)).alias("origin"),
        part(2).alias("kind"), part(3).alias("slug"), part(4).alias("file"), part(5).alias("query"),
    ).where(~F.col("slug").rlike(r"^\.+\z"))
    ver = T.blank_to_null(F.regexp_extract("query", r"(?:^|&(?:amp;)?)ver=([^&#]+)", 1))
    library = F.concat(F.lit("/"), "file").rlike(rf"(?i)/(?:{LIBRARY_DIRS})/") | F.col("file").rlike(
        rf"(?i)(?:^|/)(?:[^/]*[^a-z/])?(?:{LIBRARY_NAMES})(?:[^a-z/][^/]*)?\z"
    )
    named = (F.col("kind") == "themes") & F.contains("file", ver)
    own = F.when(~library & ~F.coalesce(named, F.lit(False)), ver)
    folder = F.concat(F.lit("/"), "kind", F.lit("/"), "slug", F.lit("/"))
    base = F.when(F.col("origin").isNotNull(), F.left("matched", F.position(folder, F.col("matched")) + F.length(folder) - 1))
    return rows.select("page_id", "kind", "slug", base.alias("base"), "file", own.alias("ver"), "matched", "ord")


def namespaces(probes: DataFrame) -> DataFrame:
    """(page_id, pos, ns): distinct REST namespaces, from JSON or from cut-off JSON."""
    listed = F.from_json("text", "struct<namespaces:array<string>>")["namespaces"]
    block = F.regexp_extract("text", r'"namespaces"\s*:\s*\[([^\]]*)\]', 1)
    raw = F.transform(
        F.regexp_extract_all(block, F.lit(r'"((?:[^"\\]|\\.)+)"'), F.lit(1)), lambda x: F.replace(x, F.lit("\\/"), F.lit("/"))
    )
    strict = F.col("text").rlike(r"(?s)\}\s*\z")
    names = F.filter(F.when(strict, F.coalesce(listed, raw)).otherwise(raw), lambda x: F.coalesce(x != "", F.lit(False)))
    return probes.where("kind = 'rest' and text is not null").select("page_id", F.posexplode(F.array_distinct(names)).alias("pos", "ns"))


def _namespace_owner(ns: Column, catalog=None) -> Column:
    """The catalog plugin of a namespace, first in catalog order: one CASE over the catalog's fixed list."""
    owner = F.lit(None).cast("string")
    for entry in reversed(catalog or C.TECH):
        for prefix in entry["ns"]:
            owner = F.when((ns == prefix.rstrip("/")) | F.startswith(ns, F.lit(prefix)), entry["id"]).otherwise(owner)
    return owner


def namespace_plugins(ns: DataFrame, catalog=None) -> DataFrame:
    """Add the catalog plugin a namespace belongs to."""
    return ns.withColumns({"tech": _namespace_owner(F.col("ns"), catalog), "core": F.col("ns").rlike(CORE_NAMESPACES)})


def probe_core_versions(probes: DataFrame) -> DataFrame:
    """(page_id, kind, version) stated by the feed and by the links file."""
    feed = F.regexp_extract("text", r"(?i)<generator>\s*https?://wordpress\.org/\?v=(\d+\.\d+(?:\.\d+)?)\s*</generator>", 1)
    opml = F.regexp_extract("text", r'(?i)generator="WordPress/(\d+\.\d+(?:\.\d+)?)"', 1)
    df = probes.where("kind in ('feed', 'opml')").withColumn("version", F.when(F.col("kind") == "feed", feed).otherwise(opml))
    return df.where("version <> ''").groupBy("page_id", "kind").agg(F.min("version").alias("version"))


def theme_headers(probes: DataFrame, head_chars: int | None = None) -> DataFrame:
    """(page_id, slug, header_name, version, template) from a theme's style header."""
    head = F.col("text") if head_chars is None else F.left("text", F.lit(head_chars))
    field = lambda n: T.blank_to_null(T.clip(F.regexp_replace(F.regexp_extract(head, rf"(?mi)^[ \t/*#@]*{n}:(.*)$", 1), r"\*/.*", ""), 80))
    df = probes.where("kind = 'theme' and text is not null")
    return df.groupBy("page_id", "slug").agg(F.min("text").alias("text")).select(
        "page_id", "slug", field("Theme Name").alias("header_name"), field("Version").alias("version"), field("Template").alias("template")
    )


def probe_status(probes: DataFrame) -> DataFrame:
    """What each probe answered."""
    label = (
        F.when(F.col("kind") == "feed", "Feed").when(F.col("kind") == "rest", "REST namespaces")
        .when(F.col("kind") == "theme", F.concat(F.lit("Theme "), "slug", F.lit(" style.css"))).otherwise("wp-links-opml.php")
    )
    return probes.select("page_id", "kind", label.alias("label"), "url", F.col("text").isNotNull().alias("ok"), "error", F.coalesce("capped", F.lit(False)).alias("capped"))


def theme_rows(assets: DataFrame, slugs: DataFrame, probes: DataFrame | None) -> DataFrame:
    """Themes of a page, the active one first, with parents and children."""
    mine = assets.where("kind = 'themes'").groupBy("page_id", "slug").agg(
        F.min("ord.seq").alias("seq"), F.min_by("base", F.when(F.col("base").isNotNull(), F.col("ord"))).alias("base")
    )
    named = slugs.select("page_id", F.explode(F.filter(F.array(
        F.struct(F.lit(2_000_000_000).cast("long").alias("seq"), F.col("child").alias("slug")),
        F.struct(F.lit(2_000_000_001).cast("long").alias("seq"), F.col("parent").alias("slug")),
    ), lambda x: x["slug"].isNotNull())).alias("s")).select("page_id", "s.slug", "s.seq", F.lit(None).cast("string").alias("base"))
    rows = mine.select("page_id", "slug", "seq", "base").unionByName(named).groupBy("page_id", "slug").agg(F.min("seq").alias("seq"), F.max("base").alias("base"))
    rows = rows.join(slugs, "page_id", "left")
    if probes is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("header_name", "version", "template")})
    else:
        rows = rows.join(theme_headers(probes), ["page_id", "slug"], "left")
    is_child, is_parent = F.coalesce(F.col("slug") == F.col("child"), F.lit(False)), F.coalesce(F.col("slug") == F.col("parent"), F.lit(False))
    body_parent = F.when(is_child & F.col("parent").isNotNull() & (F.col("parent") != F.col("slug")), F.col("parent"))
    rows = rows.select(
        "page_id", "slug", "seq", F.coalesce("header_name", "slug").alias("name"), "header_name", "version",
        F.coalesce("template", body_parent).alias("parent"), (is_child | F.col("template").isNotNull()).alias("child"),
        is_parent.alias("_body_parent"), "base",
        F.when(F.col("slug").rlike(_LISTED), F.col("slug")).alias("wporg"),
        F.array_compact(F.array(
            F.when(is_child, F.concat(F.lit('body class "wp-child-theme-'), "slug", F.lit('"')))
            .when(is_parent, F.concat(F.lit('body class "wp-theme-'), "slug", F.lit('"'))),
            F.when(F.col("base").isNotNull(), F.concat(F.lit("assets under "), T.short_url(F.col("base")))),
            F.when(
                F.coalesce("header_name", "version", "template").isNotNull(),
                F.concat(F.lit("style.css: Theme Name "), F.coalesce("header_name", F.lit("(none)")),
                         F.coalesce(F.concat(F.lit(", Version "), "version"), F.lit("")), F.coalesce(F.concat(F.lit(", Template "), "template"), F.lit(""))),
            ),
        )).alias("evidence"),
    )
    # Parent of: the themes of one page that name this one.
    children = rows.where(F.col("parent").isNotNull()).groupBy("page_id", F.col("parent").alias("slug")).agg(F.min_by("slug", "seq").alias("parent_of"))
    rows = rows.join(children, ["page_id", "slug"], "left")
    order = F.when(F.col("child"), 0).when(F.col("parent_of").isNotNull() | F.col("_body_parent"), 1).otherwise(2)
    w = W.partitionBy("page_id").orderBy(order, "seq")
    return rows.withColumn("row_no", F.row_number().over(w)).withColumn(
        "parent_of", F.when(~F.col("child"), F.col("parent_of"))
    ).drop("_body_parent", "seq")


def _mode(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent version per key, first seen on ties."""
    counts = rows.groupBy(*keys, "ver").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "ver")).alias("m")).select(*keys, F.col("m.ver").alias("asset_version"))


def likely_core(themes: DataFrame, assets: DataFrame) -> DataFrame:
    """(page_id, slug, own, version): a theme asset stamped with a foreign version."""
    t = themes.where("version is not null").select("page_id", "slug", F.col("version").alias("own"), "row_no")
    a = assets.where("kind = 'themes' and ver is not null").join(t, ["page_id", "slug"])
    a = a.where((F.col("ver") != F.col("own")) & F.col("ver").rlike(r"^(?:[3-9]|1[0-9])\.[0-9](?:\.[0-9]{1,2})?\z"))
    best = _mode(a, ["page_id", "slug", "own", "row_no"])
    return best.groupBy("page_id").agg(F.min_by(F.struct("slug", "own", "asset_version"), "row_no").alias("b")).select("page_id", "b.slug", "b.own", F.col("b.asset_version").alias("version"))


def plugin_rows(assets: DataFrame, lists: DataFrame, core: DataFrame, catalog=None) -> DataFrame:
    """Plugins of a page: catalog ones by folder or evidence, then unknown folders."""
    spark = assets.sparkSession
    dirs = F.broadcast(C.dir_table(spark, catalog))
    meta = C.tech_table(spark, catalog)
    plug = assets.where("kind = 'plugins'").withColumn("dir_key", F.lower("slug")).join(dirs, "dir_key", "left")
    plug = plug.where(F.coalesce("tech", F.lit("")) != "woocommerce").withColumn("id", F.coalesce("tech", F.concat(F.lit("slug:"), "slug")))
    seen = plug.groupBy("page_id", "id").agg(
        F.min("ord").alias("first"), F.min_by("slug", "ord").alias("slug"), F.first("tech").alias("tech"),
        F.array_sort(F.collect_set(F.struct("ord", "matched"))).alias("urls"),
    )
    seen = seen.withColumn("urls", F.transform("urls", lambda u: u["matched"]))
    versions = plug.where(is_asset_version(F.col("ver"))).join(core, "page_id", "left").where(F.col("core").isNull() | (F.col("ver") != F.col("core")))
    mode = _mode(versions, ["page_id", "id"])
    of_plugins = lists.join(F.broadcast(meta.where("`group` = 'plugin'").select("tech")), "tech").select("page_id", F.col("tech").alias("id"), "ev")
    rows = seen.join(of_plugins, ["page_id", "id"], "full").join(mode, ["page_id", "id"], "left")
    rows = rows.withColumn("tech", F.coalesce("tech", F.when(~F.startswith("id", F.lit("slug:")), F.col("id"))))
    rows = rows.join(F.broadcast(meta.select("tech", F.col("name").alias("tech_name"), F.col("wporg").alias("tech_wporg"), "wp_dir", "cat_ord")), "tech", "left")
    own = TE.pick_version(F.col("ev"))
    rows = rows.withColumn("_own", own)
    texts = F.coalesce(TE.ordered_evidence(F.col("ev"), F.col("_own")), F.transform("urls", lambda u: F.concat(F.lit("plugin asset: "), T.short_url(u))))
    note = F.when(F.col("_own").isNull() & F.col("asset_version").isNotNull(), F.concat(F.lit("?ver="), "asset_version", F.lit(" on its assets")))
    named = F.col("tech").isNotNull()
    version = F.coalesce("_own.version", "asset_version")
    w = W.partitionBy("page_id").orderBy(F.col("named").desc(), "first_seq", "cat_ord", "name")
    out = rows.select(
        "page_id", "id", F.coalesce("slug", "wp_dir").alias("slug"), F.coalesce("tech_name", "slug").alias("name"), named.alias("named"),
        F.when(version.isNotNull(), V.clean_version(version)).alias("version"),
        F.when(named, F.col("tech_wporg")).otherwise(F.when(F.col("slug").rlike(_LISTED), F.col("slug"))).alias("wporg"),
        F.array_compact(F.concat(texts, F.array(note))).alias("evidence"),
        F.when(named, F.coalesce("first", F.struct(F.lit(4_000_000_000).cast("long").alias("seq"), F.lit(0).alias("_i")))).alias("first_seq"), "cat_ord",
    )
    return out.withColumn("row_no", F.row_number().over(w)).drop("first_seq", "cat_ord")


_LINE = "struct<tech:string,text:string,version:string,rank:int,likely:boolean,src_ord:int,pat_ord:int,seq:bigint>"


def _line(src: int, tech: Column, text: Column, version: Column, rank: int, likely: bool = False, seq: Column | None = None) -> Column:
    seq = F.lit(0) if seq is None else seq
    return F.struct(
        tech.alias("tech"), text.alias("text"), version.cast("string").alias("version"), F.lit(rank).alias("rank"), F.lit(likely).alias("likely"),
        F.lit(src).alias("src_ord"), F.lit(0).alias("pat_ord"), seq.cast("long").alias("seq"),
    ).cast(_LINE)


def _tagged(df: DataFrame, tag: str, *names: str) -> DataFrame:
    """Rows of one kind for a table of several: (page_id, tag, and the columns ``names`` or all in a struct named by the tag)."""
    names = names or tuple(c for c in df.columns if c != "page_id")
    return df.select("page_id", F.lit(tag).alias("tag"), F.struct(*names).alias(tag))


def _together(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def _of(table: DataFrame, tag: str) -> DataFrame:
    return table.where(F.col("tag") == tag).select("page_id", f"{tag}.*")


def _facts(signals, requests, headers, runtime, probes, catalog) -> DataFrame:
    """What detection knows of a page, in buckets of pages: lines, assets, slugs, namespaces and probe answers, each tagged."""
    # Addresses and body classes first: addresses are distinct within a bucket, and folders found through a theme name meet them there.
    seen = bucketed(_together(_tagged(TE.page_urls(signals, requests), "url"), _tagged(body_themes(signals), "body")), "page_id")
    urls, slugs = _of(seen, "url"), _of(seen, "body")
    parts = [
        _tagged(TE.base_evidence(signals, headers=headers, runtime=runtime, catalog=catalog, urls=urls), "line"),
        _tagged(asset_paths(signals, urls, slugs), "asset"), _tagged(slugs, "body"),
    ]
    if probes is not None:
        parts.append(_tagged(probes, "probe", "kind", "slug", "text"))
    return bucketed(_together(*parts), "page_id")


def detect(signals: DataFrame, requests=None, headers=None, runtime=None, probes=None, catalog=None) -> dict[str, DataFrame]:
    """All technology tables of a crawl: tech, themes, plugins, namespaces, cms_pages.

    Facts of every source are dealt to buckets of pages once. Folds follow inside the buckets, without an exchange:
    themes with the core version, then evidence lists; each ends in a table of the same buckets.
    """
    spark = signals.sparkSession
    facts = _facts(signals, requests, headers, runtime, probes, catalog)
    assets, slugs, lines = _of(facts, "asset"), _of(facts, "body"), _of(facts, "line")
    more = lambda df, line: df.select("page_id", line.alias("l")).select("page_id", "l.*")
    none = F.lit(None)
    wordpress = F.lit("wordpress")
    spaces = answers = None
    if probes is not None:
        answers = _of(facts, "probe")
        spaces = namespace_plugins(namespaces(answers), catalog)
        owned = spaces.where("tech is not null").groupBy("page_id", "tech").agg(F.array_sort(F.collect_list(F.struct("pos", "ns"))).alias("l"))
        shown = F.array_join(F.transform("l", lambda x: x["ns"]), ", ")
        text = F.concat(F.when(F.size("l") > 1, "REST namespaces ").otherwise("REST namespace "), shown)
        stated, feed = probe_core_versions(answers), F.col("kind") == "feed"
        from_feed = _line(21, wordpress, F.concat(F.lit("feed generator wordpress.org/?v="), "version"), F.col("version"), 3)
        from_opml = _line(22, wordpress, F.concat(F.lit("wp-links-opml.php generator WordPress/"), "version"), F.col("version"), 4)
        lines = lines.unionByName(more(owned, _line(20, F.col("tech"), text, none, C.RANK["ns"]))).unionByName(more(stated, F.when(feed, from_feed).otherwise(from_opml)))
    stated_core = TE.evidence_lists(lines.where("tech = 'wordpress' and version is not null"))
    stated_core = stated_core.select("page_id", TE.pick_version(F.col("ev"))["version"].alias("core"))
    first = bucketed(_together(_tagged(theme_rows(assets, slugs, answers), "theme"), _tagged(stated_core, "stated")), "page_id")
    themes, stated_core = _of(first, "theme"), _of(first, "stated")
    guess = likely_core(themes, assets).join(stated_core, "page_id", "left_anti")
    text = F.concat(F.lit("theme asset ?ver="), "version", F.lit(" under themes/"), "slug", F.lit("/ (its style.css says "), "own",
                    F.lit("): WordPress stamps its own version on assets without one"))
    lines = lines.unionByName(more(guess, _line(23, wordpress, text, F.col("version"), 9, True)))
    core = stated_core.unionByName(guess.select("page_id", F.col("version").alias("core")))
    # Plugin folders of catalog entries are evidence lines too; the shop platform takes its version from them.
    known = assets.where("kind = 'plugins'").withColumn("dir_key", F.lower("slug")).join(F.broadcast(C.dir_table(spark, catalog)), "dir_key")
    shop_ok = known.where("tech = 'woocommerce'").where(is_asset_version(F.col("ver"))).join(core, "page_id", "left")
    shop = _mode(shop_ok.where(F.col("core").isNull() | (F.col("ver") != F.col("core"))), ["page_id", "tech"])
    stamped = known.join(shop, ["page_id", "tech"], "left")
    lines = lines.unionByName(more(stamped, _line(24, F.col("tech"), F.concat(F.lit("plugin asset: "), T.short_url(F.col("matched"))), TE.valid_version(F.col("asset_version")), C.RANK["url"] + 1, seq=F.col("ord.seq"))))
    second = bucketed(_together(_tagged(TE.evidence_lists(lines), "list"), _tagged(core, "core")), "page_id")
    lists, core = _of(second, "list"), _of(second, "core")
    found = assets.select("page_id").unionByName(slugs.select("page_id"))
    if spaces is not None:
        found = found.unionByName(spaces.select("page_id"))
    plugin_ids = F.broadcast(C.tech_table(spark, catalog).where("`group` = 'plugin' or tech = 'wordpress'").select("tech"))
    cms_pages = found.unionByName(lists.join(plugin_ids, "tech", "left_semi").select("page_id")).distinct()
    rows = TE.tech_rows(TE.with_implied(lists, cms_pages, catalog), catalog, TE.storefront_theme(signals, runtime))
    return {
        "tech": rows, "themes": themes, "plugins": plugin_rows(assets, lists, core, catalog), "cms_pages": cms_pages,
        "namespaces": spaces, "core": core, "assets": assets,
    }


# ---- probe fetch list


def _usable(url: Column, origin: Column) -> Column:
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.coalesce((U.origin_of(url) == origin) & ~path.rlike(FORBIDDEN_PATH), F.lit(False))


def probe_targets(pages: DataFrame, signals: DataFrame, cms_pages: DataFrame, themes: DataFrame, requests=None, headers=None, max_themes: int | None = None) -> DataFrame:
    """(page_id, kind, slug, url) a fetcher may read for a CMS page.

    Same origin as the page, never a forbidden path; ``max_themes`` limits the themes of a page.
    """
    page = pages.select("page_id", U.normalize(F.col("url")).alias("_page")).join(cms_pages, "page_id", "left_semi")
    page = page.withColumn("_origin", U.origin_of(F.col("_page"))).where(F.col("_origin").isNotNull())
    first = lambda df, prio: df.groupBy("page_id").agg(F.min_by("url", prio).alias("url"))
    near = lambda df: df.join(page.select("page_id", "_origin"), "page_id").where(_usable(F.col("url"), F.col("_origin")))
    feeds = near(signals.where("kind = 'feed'").select("page_id", "seq", F.col("value").alias("url")))
    comments = F.regexp_extract("url", r"(?i)^https?://[^/?#]*([^?#]*)", 1).rlike(r"(?i)/comments/feed/?\z")
    feed = first(feeds.where(~comments), "seq").withColumnRenamed("url", "feed")
    inc = TE.page_urls(signals, requests).select("page_id", "seq", T.blank_to_null(F.regexp_extract("value", r"^(https?://[^?#\s]*?/)wp-includes/", 1)).alias("url"))
    root = first(near(inc.where("url is not null")), "seq").withColumnRenamed("url", "root")
    rest = signals.where("kind = 'rest'").select("page_id", F.col("seq").alias("seq"), F.col("value").alias("url"))
    if headers is not None:
        link = headers.where("header = 'link'").select(
            "page_id", F.explode(F.regexp_extract_all("value", F.lit(r'(?i)<([^>]+)>\s*;\s*rel="?https://api\.w\.org/"?'), F.lit(1))).alias("url"))
        rest = rest.unionByName(link.join(page, "page_id").select("page_id", F.lit(1000).alias("seq"), U.resolve(F.col("url"), U.base_parts(F.col("_page"))).alias("url")))
    rest = first(near(rest), "seq").withColumnRenamed("url", "rest")
    df = page.join(feed, "page_id", "left").join(root, "page_id", "left").join(rest, "page_id", "left")
    beside = F.when(F.col("feed").rlike(r"^[^?#]*/feed/?(?:[?#]|\z)"), F.regexp_replace("feed", r"feed/?(?:[?#].*)?\z", "wp-json/"))
    df = df.withColumn("rest", F.coalesce("rest", beside, F.concat("root", F.lit("wp-json/"))))
    df = df.withColumn("root", F.coalesce("root", F.when(F.col("rest").rlike(r"/wp-json/\z"), F.regexp_replace("rest", r"wp-json/\z", ""))))
    rest_url = F.concat("rest", F.when(F.col("rest").contains("?"), "&").otherwise("?"), F.lit("_fields=namespaces"))
    targets = df.select("page_id", F.explode(F.array(
        F.struct(F.lit("feed").alias("kind"), F.col("feed").alias("url")), F.struct(F.lit("rest").alias("kind"), rest_url.alias("url")),
        F.struct(F.lit("opml").alias("kind"), F.concat("root", F.lit("wp-links-opml.php")).alias("url")),
    )).alias("t")).select("page_id", "t.kind", F.lit(None).cast("string").alias("slug"), "t.url").where(F.col("url").isNotNull())
    styles = near(themes.where("base is not null").select("page_id", "slug", "row_no", F.concat("base", F.lit("style.css")).alias("url")))
    if max_themes is not None:
        w = W.partitionBy("page_id").orderBy("row_no")
        styles = styles.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_themes)
    return targets.unionByName(styles.select("page_id", F.lit("theme").alias("kind"), "slug", "url"))


def accepted_probes(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """Probe answers whose address is same-origin, well shaped and not forbidden."""
    page = pages.select("page_id", U.origin_of(F.col("url")).alias("_origin"))
    path = F.regexp_extract("url", r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    shape = (
        F.when(F.col("kind") == "feed", F.lit(True))
        .when(F.col("kind") == "rest", F.col("url").rlike(r"[?&]_fields=namespaces(?:&|#|\z)") & (path.contains("/wp-json/") | F.col("url").rlike(r"[?&]rest_route=")))
        .when(F.col("kind") == "opml", path.rlike(r"/wp-links-opml\.php\z"))
        .when(F.col("kind") == "theme", path.rlike(r"/themes/[^/]+/style\.css\z"))
    )
    return probes.join(page, "page_id").where(shape & _usable(F.col("url"), F.col("_origin"))).drop("_origin")
