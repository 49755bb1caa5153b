"""Registered queries and their check SQL.

The SQL works on the given tables: by plain patterns on raw pages, by the fixture rules
on enriched ones. Queries without SQL are checked by golden cases in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from crawlaudit.catalog import tech as tech_catalog, trackers as tracker_catalog
from crawlaudit.functions import directives as D, html as H, text as T, urls as U, versions as V
from crawlaudit.operators import cms, containers as K, corpus, elements as EL, export, extract as X, hreflang as HL, latest as L
from crawlaudit.operators import page as A, robots as R, serp, skew, structured as SD, tech as TE, trackers as TR
from crawlaudit.plans import audit
from crawlaudit.sources import tables
from crawlaudit.streaming import incremental as INC, refine as RF

from . import fixtures as FX, samples as SA

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SITE = "'https://s' || (p % 7) || '.example.com'"
RULES = "WITH e AS (SELECT page_id AS p, page_id, 'https://s' || (page_id % 7) || '.example.com/en/' || page_id AS url, html FROM pages) "


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with check SQL when it has one."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def _raw(spark, sf) -> DataFrame:
    return tables.read_pages(spark, f"{sf}/pages.parquet", FX.splits(spark))


def _documents(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(FX.splits(spark), "doc_id")


def longs(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, like the check SQL."""
    kinds = {"int", "tinyint", "smallint"}
    return df.select(*[F.col(n).cast("bigint").alias(n) if t in kinds else F.col(f"`{n}`") for n, t in df.dtypes])


def joined(c: str, sep: str = "|"):
    return F.array_join(c, sep).alias(c.split(".")[-1])


DEC = lambda x: f"""replace(replace(replace(replace({x}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
CLEAN = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
BARE = "regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '')"
NAV = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
ENC = lambda x: f"replace(replace(replace(url_encode({x}), '%2F', '/'), '%2C', ','), '%26', '&')"
TEXT = DEC(
    "regexp_replace(regexp_replace(regexp_replace(substr(html, strpos(html, '<body>')), '<!--.*?-->', '', 'g'), "
    "'</?(nav|ul|li|div|article|h1|p|br|footer|body|html)( [^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')"
)
WORDS = f"len(regexp_extract_all({TEXT}, '[\\p{{L}}\\p{{N}}]+(?:[''’-][\\p{{L}}\\p{{N}}]+)*'))"
TITLE = CLEAN(DEC("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
STATUS = lambda x, lo, hi: f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'missing' WHEN length({x}) < {lo} THEN 'short' WHEN length({x}) > {hi} THEN 'long' ELSE 'good' END"

# ---------------------------------------------------------------- extraction on raw pages


@query(f"SELECT page_id, {TITLE} AS title, CAST(1 AS BIGINT) AS title_count, {STATUS(TITLE, 30, 60)} AS status, CAST(length({TITLE}) AS BIGINT) AS chars FROM pages")
def page_titles(spark, sf):
    r = X.page_records(_raw(spark, sf), "head")
    t = F.col("head.title")
    return longs(r.select("page_id", t.alias("title"), "head.title_count", T.length_status(t, T.TITLE_RANGE).alias("status"), F.length(t).alias("chars")))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, 'utf-8' AS charset, CAST(NULL AS VARCHAR) AS dir FROM pages")
def document_language(spark, sf):
    return X.page_records(_raw(spark, sf), "head").select("page_id", "head.lang", "head.charset", "head.dir")


@query(f"SELECT page_id, CAST({WORDS} AS BIGINT) AS word_count FROM pages")
def word_counts(spark, sf):
    return longs(X.page_records(_raw(spark, sf), "word_count").select("page_id", "word_count"))


@query("""SELECT tag, CAST(count(*) AS BIGINT) AS elements FROM (SELECT unnest(regexp_extract_all(
    regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script>', 'g'), '<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY tag""")
def element_counts(spark, sf):
    return X.elements(_raw(spark, sf)).groupBy("tag").agg(F.count("*").alias("elements"))


@query(f"SELECT page_id, CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS level, {CLEAN(DEC('''regexp_extract(html, '<h1>([^<]*)</h1>', 1)'''))} AS text FROM pages")
def heading_rows(spark, sf):
    return longs(X.children(X.page_records(_raw(spark, sf), "headings"), "headings"))


@query(f"""SELECT page_id, CAST(idx AS BIGINT) AS idx, raw, o || {ENC('raw')} AS href, {DEC('text')} AS text FROM (
    SELECT page_id, {ORIGIN} AS o, unnest(range(len({NAV}))) AS idx, unnest({NAV}) AS raw,
      unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM pages)""")
def link_rows(spark, sf):
    rows = X.children(X.page_records(_raw(spark, sf), "links"), "links")
    return longs(rows.select("page_id", "idx", "raw", "href", "text"))


@query("SELECT page_id, CAST(0 AS BIGINT) AS seq, regexp_extract(html, '<script>(.*?)</script>', 1) AS value FROM pages")
def inline_scripts(spark, sf):
    s = X.signals(X.page_records(_raw(spark, sf), *X.SIGNAL_COLUMNS)).where("kind = 'inline'")
    return longs(s.select("page_id", "seq", "value"))


@query("SELECT page_id, CAST(0 AS BIGINT) AS seq, trim(regexp_extract(html, '<!--(.*?)-->', 1)) AS value FROM pages")
def html_comments(spark, sf):
    return longs(X.children(X.page_records(_raw(spark, sf), "comments"), "comments").select("page_id", F.col("idx").alias("seq"), "value"))


@query(f"""SELECT {BARE} AS host, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (length({TITLE}) BETWEEN 30 AND 60) AS BIGINT) AS good_titles,
    CAST(0 AS BIGINT) AS h1_issues, CAST(sum({WORDS}) AS BIGINT) AS words, CAST(sum(len({NAV})) AS BIGINT) AS links,
    CAST(sum(len({NAV})) AS BIGINT) AS internal_links, CAST(0 AS BIGINT) AS external_links FROM pages GROUP BY 1""")
def site_rollup(spark, sf):
    return audit.site_rollup(_raw(spark, sf))


@query(f"SELECT {BARE} AS domain, CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1")
def pages_per_domain(spark, sf):
    return corpus.pages_per_domain(FX.pages(spark, sf))


WHOLE = lambda x: CLEAN(f"regexp_replace({x}, '[\"“”„«»]', ' ', 'g')")
PHRASE = lambda x: "array_to_string(list_slice(string_split(" + CLEAN(f"regexp_replace({x}, '[\"“”„«»]', ' ', 'g')") + ", ' '), 1, 32), ' ')"


@query(f"""WITH t AS (SELECT page_id, {WHOLE(TITLE)} AS phrase FROM pages), c AS (SELECT phrase, count(*) AS n, min(page_id) AS f FROM t WHERE phrase <> '' GROUP BY 1 HAVING count(*) > 1)
    SELECT page_id, t.phrase, CAST(n AS BIGINT) AS pages, f AS first_page FROM t JOIN c ON t.phrase = c.phrase""")
def duplicate_titles(spark, sf):
    return corpus.phrase_copy_members(X.page_records(_raw(spark, sf), "head"), F.col("head.title"))


@query(RULES + f"""SELECT d AS phrase, CAST(count(*) AS BIGINT) AS pages, min(p) AS first_page FROM (SELECT p, CASE p % 4 WHEN 2 THEN {WHOLE("repeat('ab ', 26) || 'zz'")}
    WHEN 3 THEN {WHOLE("repeat('cd ', 66) || 'yy'")} END AS d FROM e) WHERE d IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_descriptions(spark, sf):
    return corpus.phrase_copies(X.page_records(FX.enriched(spark, sf), "head"), F.coalesce("head.description", F.lit("")))


def _url_index(spark, sf):
    urls = FX.pages(spark, sf).where("page_id % 3 = 0").select(F.concat(F.regexp_replace("url", "https?://(?:www\\.)?", "http://www."), F.lit("#x")).alias("url"))
    return urls.select(U.bare_url(F.col("url")).alias("bare_url"))


_BAREURL = "regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '^www\\.', ''), '/$', '')"


@query(f"SELECT page_id, {_BAREURL} AS bare_url FROM pages WHERE {_BAREURL} IN (SELECT {_BAREURL} FROM pages WHERE page_id % 3 = 0)")
def indexed_pages(spark, sf):
    return corpus.indexed(FX.pages(spark, sf), _url_index(spark, sf)).select("page_id", "bare_url")


@query(f"SELECT page_id, {_BAREURL} AS bare_url FROM pages WHERE {_BAREURL} NOT IN (SELECT {_BAREURL} FROM pages WHERE page_id % 3 = 0)")
def unindexed_pages(spark, sf):
    return corpus.indexed(FX.pages(spark, sf), _url_index(spark, sf), known=False).select("page_id", "bare_url")


@query(RULES + """SELECT 's' || (p * 3 % 7) || '.example.com' AS domain, 's' || (p % 7) || '.example.com' AS host, CAST(count(*) AS BIGINT) AS mentions
    FROM e WHERE p * 3 % 7 <> p % 7 GROUP BY 1, 2""")
def domain_mentions(spark, sf):
    df = FX.enriched(spark, sf)
    texts = df.select(U.bare_host(F.col("url")).alias("host"), F.expr("concat('Mail me@s9.example.com or see WWW.S', page_id * 3 % 7, '.example.com, s.example.community')").alias("text"))
    return corpus.domain_mentions(texts, corpus.pages_per_domain(df))


DOC = CLEAN("regexp_replace(text, '[\"“”„«»]', ' ', 'g')")


@query(f"""WITH d AS (SELECT doc_id, ' ' || {DOC} || ' ' AS body FROM documents), b AS (SELECT DISTINCT {WHOLE('text')} AS phrase FROM benchmark)
    SELECT phrase, doc_id FROM b JOIN d ON contains(body, ' ' || phrase || ' ') WHERE phrase <> ''""")
def passage_copies(spark, sf):
    return corpus.passage_copies(spark.read.parquet(f"{sf}/benchmark.parquet"), _documents(spark, sf))


@query(f"""WITH d AS (SELECT doc_id, ' ' || {DOC} || ' ' AS body FROM documents)
    SELECT item_id, CAST(count(doc_id) AS BIGINT) AS copies FROM benchmark b LEFT JOIN d ON contains(body, ' ' || {WHOLE('b.text')} || ' ') GROUP BY item_id""")
def passage_copy_counts(spark, sf):
    return corpus.passage_copy_counts(spark.read.parquet(f"{sf}/benchmark.parquet"), _documents(spark, sf))


@query(f"SELECT doc_id, {PHRASE('text')} AS phrase FROM documents")
def exact_phrases(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.exact_phrase(F.col("text")).alias("phrase"))


@query("""SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 89) || '…' ELSE t END AS clipped, CAST(length(t) AS BIGINT) AS chars FROM (
    SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def clipped_texts(spark, sf):
    t = F.col("text")
    return longs(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.clip(t).alias("clipped"), F.length(T.clean(t)).alias("chars")))


@query(f"""SELECT page_id, lower({ORIGIN}) || CASE WHEN regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1) END AS stripped,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, {BARE} AS bare_host, lower({ORIGIN}) AS origin, {_BAREURL} AS bare_url FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return FX.pages(spark, sf).select(
        "page_id", U.strip_hash(u).alias("stripped"), U.host_of(u).alias("host"), U.bare_host(u).alias("bare_host"),
        U.origin_of(u).alias("origin"), U.bare_url(u).alias("bare_url"))


@query(RULES + f"""SELECT p AS page_id, {SITE} || '/en/a%20b/' || p AS rel, {SITE} || '/x?y=%C3%A9' AS root, 'https://cdn.example.org/z' AS protocol, url || '?q=1' AS query_only,
    url || '#f' AS fragment, {SITE} || '/up' AS up, 'mailto:a@b.c' AS mail, url AS empty, '' AS none, 'http://ex.com/' AS host_case FROM e""")
def resolved_urls(spark, sf):
    df = FX.enriched(spark, sf).withColumn("b", U.base_parts(U.normalize(F.col("url"))))
    r = lambda s: U.resolve(s, F.col("b"))
    return df.select(
        "page_id", r(F.concat(F.lit(" ./a b/"), "page_id")).alias("rel"), r(F.lit("/x?y=é")).alias("root"), r(F.lit("//cdn.example.org/a/../z")).alias("protocol"),
        r(F.lit("?q=1")).alias("query_only"), r(F.lit("#f")).alias("fragment"), r(F.lit("../up")).alias("up"), r(F.lit("mailto:a@b.c")).alias("mail"),
        r(F.lit("")).alias("empty"), r(F.lit(None).cast("string")).alias("none"), r(F.lit("HTTP://EX.com:80")).alias("host_case"))


# ---------------------------------------------------------------- head and page verdicts on enriched pages

DESC = "CASE p % 4 WHEN 1 THEN '' WHEN 2 THEN repeat('ab ', 26) || 'zz' WHEN 3 THEN repeat('cd ', 66) || 'yy' END"
ROBOTS = "CASE p % 6 WHEN 0 THEN 'noindex' WHEN 1 THEN 'NoFollow' WHEN 2 THEN 'none' WHEN 3 THEN 'max-snippet: 50, noindex' END"


@query(RULES + f"""SELECT p AS page_id, {DESC} AS description, CAST(CASE p % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS description_count,
    CASE p % 4 WHEN 2 THEN 'good' WHEN 3 THEN 'long' ELSE 'missing' END AS description_status, {ROBOTS} AS robots, CAST(CASE WHEN p % 6 < 4 THEN 1 ELSE 0 END AS BIGINT) AS robots_count,
    CASE WHEN p % 13 = 0 THEN 'bingbot: noindex, googlebot: nofollow' END AS googlebot, CASE WHEN p % 3 <> 0 THEN 'width=device-width' END AS viewport,
    CASE p % 8 WHEN 0 THEN 'WordPress 6.9.4' WHEN 2 THEN 'Drupal 10 (https://www.drupal.org)' WHEN 6 THEN 'Ghost 5.82' WHEN 4 THEN NULL ELSE 'WordPressy 9.9' END AS generator FROM e""")
def named_metas(spark, sf):
    h = F.col("head")
    r = X.page_records(FX.enriched(spark, sf), "head")
    return longs(r.select(
        "page_id", h["description"].alias("description"), h["description_count"].alias("description_count"),
        T.length_status(h["description"], T.DESCRIPTION_RANGE).alias("description_status"), h["robots"].alias("robots"), h["robots_count"].alias("robots_count"),
        h["googlebot"].alias("googlebot"), h["viewport"].alias("viewport"), h["generator"].alias("generator")))


@query(RULES + f"""SELECT p AS page_id, {SITE} || '/favicon.ico' AS favicon, CAST(NULL AS VARCHAR) AS amphtml, CAST(NULL AS VARCHAR) AS prev, CAST(NULL AS VARCHAR) AS next,
    CASE WHEN p % 11 = 0 THEN '5; url=/next' END AS meta_refresh, CAST(NULL AS VARCHAR) AS base FROM e""")
def head_links(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "head")
    return r.select("page_id", *[F.col(f"head.{c}").alias(c) for c in ("favicon", "amphtml", "prev", "next", "meta_refresh", "base")])


@query(RULES + f"""SELECT p AS page_id, CAST(0 AS BIGINT) AS idx, CASE p % 5 WHEN 0 THEN url || '#frag' WHEN 1 THEN 'https://canonical.example.org/x' WHEN 3 THEN url ELSE '' END AS href,
    CASE p % 5 WHEN 0 THEN url || '#frag' WHEN 1 THEN 'https://canonical.example.org/x' WHEN 3 THEN url END AS raw FROM e WHERE p % 5 <> 2
    UNION ALL SELECT p, 1, {SITE} || '/other', '/other' FROM e WHERE p % 5 = 3""")
def canonical_links(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "head").select("page_id", "head.canonicals")
    return longs(X.children(r, "canonicals"))


@query(RULES + "SELECT p AS page_id, CASE p % 5 WHEN 0 THEN 'self' WHEN 1 THEN 'other' WHEN 2 THEN 'missing' WHEN 3 THEN 'conflict' ELSE 'empty' END AS canonical_status FROM e")
def canonical_status(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "head")
    return r.select("page_id", A.canonical_status(F.col("head.canonicals"), F.col("url")).alias("canonical_status"))


@query(RULES + """SELECT p AS page_id, CAST(NULL AS VARCHAR) AS agent, unnest(CASE p % 6 WHEN 0 THEN ['noindex'] WHEN 1 THEN ['nofollow'] WHEN 2 THEN ['none'] WHEN 3 THEN ['max-snippet: 50', 'noindex'] ELSE [] END) AS directive FROM e
    UNION ALL SELECT p, 'bingbot', 'noindex' FROM e WHERE p % 13 = 0 UNION ALL SELECT p, 'googlebot', 'nofollow' FROM e WHERE p % 13 = 0""")
def robots_directives(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "head")
    both = F.concat(D.parse_directives(F.col("head.robots")), D.parse_directives(F.col("head.googlebot")))
    return r.select("page_id", F.explode(both).alias("d")).select("page_id", "d.agent", "d.directive")


@query(RULES + """SELECT p AS page_id, CASE WHEN p % 6 IN (0, 2, 3) THEN 'noindex' WHEN p % 6 = 1 OR p % 13 = 0 THEN 'nofollow' ELSE 'index, follow' END AS chip,
    p % 6 IN (0, 2, 3) AS noindex, p % 6 IN (1, 2) OR p % 13 = 0 AS nofollow FROM e""")
def robots_verdicts(spark, sf):
    m = A.meta_directives(F.col("head"))
    r = X.page_records(FX.enriched(spark, sf), "head")
    return r.select("page_id", D.directives_chip(m).alias("chip"), D.has_noindex(m).alias("noindex"), D.has_nofollow(m).alias("nofollow"))


PATH_RULE = "CASE WHEN '' || p LIKE '12%' THEN 'Allow: /en/12' WHEN '' || p LIKE '1%' THEN 'Disallow: /en/1' WHEN '' || p LIKE '%5' THEN 'Disallow: /*5$' END"
ALLOWED = f"CASE p % 7 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN NULL ELSE coalesce({PATH_RULE} NOT LIKE 'Dis%', true) END"
VERDICT = f"""SELECT p AS page_id, array_to_string(list_filter([
      CASE WHEN p % 6 IN (0, 2, 3) THEN 'noindex in meta robots' END, CASE WHEN p % 17 <> 0 AND p % 10 = 0 THEN 'HTTP status 404' END,
      CASE WHEN p % 17 <> 0 AND p % 7 = 3 THEN 'noindex in X-Robots-Tag header' END, CASE WHEN {ALLOWED} = false THEN 'blocked by robots.txt' END,
      CASE p % 5 WHEN 1 THEN 'canonical points to another URL' WHEN 3 THEN 'conflicting canonical tags' END,
      CASE WHEN p % 11 = 0 THEN 'meta refresh redirect' END], lambda x: x IS NOT NULL), '|') AS reasons,
    array_to_string(list_filter([CASE WHEN p % 17 = 0 THEN 'HTTP headers' END, CASE WHEN p % 7 = 3 THEN 'robots.txt' END], lambda x: x IS NOT NULL), '|') AS unknown FROM e"""


@query(RULES + f", v AS ({VERDICT}) SELECT page_id, reasons = '' AS indexable, reasons, unknown FROM v")
def indexability(spark, sf):
    v = audit.indexability(FX.enriched(spark, sf), FX.responses(spark, sf), FX.robots_files(spark, sf))
    return v.select("page_id", "indexable", joined("reasons"), joined("unknown"))


@query(RULES + """SELECT p AS page_id, CASE p % 3 WHEN 0 THEN 'warn:2 H1 tags' WHEN 1 THEN 'warn:Skips from H2 to H4' ELSE 'warn:1 empty heading' END AS issues FROM e""")
def heading_issues(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "headings")
    text = F.transform(A.heading_issues(F.col("headings")), lambda i: F.concat(i["level"], F.lit(":"), i["text"]))
    return r.select("page_id", F.array_join(text, "|").alias("issues"))


@query(RULES + """SELECT p AS page_id, CAST(CASE p % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS h1, CAST(CASE p % 3 WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS h2, CAST(0 AS BIGINT) AS h3,
    CAST(CASE p % 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS h4, CAST(0 AS BIGINT) AS h5, CAST(0 AS BIGINT) AS h6 FROM e""")
def heading_counts(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "headings")
    return longs(r.select("page_id", *A.heading_counts(F.col("headings"))))


def _links(spark, sf):
    r = A.classify_links(X.page_records(FX.enriched(spark, sf), "links"))
    return X.children(r, "links", "url")


ADDED_LINKS = f"""SELECT p AS page_id, CAST(a.i AS BIGINT) AS idx, a.href, a.text, a.src AS text_source, a.kind, a.rel, a.target, a.kind = 'external' AS qualified FROM (SELECT p, unnest([
    {{'i': 0, 'href': 'https://www.s' || (p % 7) || '.example.com/w', 'text': 'Www', 'src': 'text', 'kind': 'internal', 'rel': '', 'target': ''}},
    {{'i': 1, 'href': 'https://out.example.net/x', 'text': 'Out', 'src': 'text', 'kind': 'external', 'rel': CASE p % 3 WHEN 0 THEN 'nofollow' WHEN 1 THEN 'ugc' ELSE 'sponsored noopener' END, 'target': '_blank'}},
    {{'i': 2, 'href': 'mailto:a@example.com', 'text': 'Mail', 'src': 'text', 'kind': 'mailto', 'rel': '', 'target': ''}},
    {{'i': 3, 'href': 'tel:+123', 'text': 'Call', 'src': 'text', 'kind': 'tel', 'rel': '', 'target': ''}},
    {{'i': 4, 'href': url || '#top', 'text': 'Top', 'src': 'text', 'kind': 'fragment', 'rel': '', 'target': ''}},
    {{'i': 5, 'href': 'javascript:void(0)', 'text': 'Js', 'src': 'text', 'kind': 'javascript', 'rel': '', 'target': ''}},
    {{'i': 6, 'href': {SITE} || '/empty', 'text': '', 'src': 'text', 'kind': 'internal', 'rel': '', 'target': ''}},
    {{'i': 7, 'href': {SITE} || '/img', 'text': 'Logo', 'src': 'image alt', 'kind': 'internal', 'rel': '', 'target': ''}}]) AS a FROM e)"""
NAV_LINKS = f"""SELECT p AS page_id, CAST(8 + i AS BIGINT) AS idx, {SITE} || {ENC('raw')} AS href, {DEC('text')} AS text, 'text' AS text_source, 'internal' AS kind, '' AS rel, '' AS target, false AS qualified
    FROM (SELECT p, unnest(range(len({NAV}))) AS i, unnest({NAV}) AS raw, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM e)"""


@query(RULES + ADDED_LINKS + " UNION ALL " + NAV_LINKS)
def link_kinds(spark, sf):
    return longs(_links(spark, sf).select("page_id", "idx", "href", "text", "text_source", "kind", "rel", "target", "qualified"))


@query(RULES + f"""SELECT p AS page_id, CAST(8 + len({NAV}) AS BIGINT) AS total, CAST(8 + len(list_distinct({NAV})) AS BIGINT) AS "unique", CAST(3 + len({NAV}) AS BIGINT) AS internal,
    CAST(1 AS BIGINT) AS "external", CAST(1 AS BIGINT) AS nofollow, CAST(4 AS BIGINT) AS other, CAST(1 AS BIGINT) AS no_text FROM e""")
def link_stats(spark, sf):
    r = A.classify_links(X.page_records(FX.enriched(spark, sf), "links"))
    return longs(r.select("page_id", A.link_stats(F.col("links")).alias("s")).select("page_id", "s.*"))


@query(RULES + f"SELECT page_id, idx, href FROM ({ADDED_LINKS} UNION ALL {NAV_LINKS}) WHERE kind = 'internal' AND (contains(lower(href), 'an') OR contains(lower(text), 'an'))")
def filtered_links(spark, sf):
    return longs(A.filter_links(_links(spark, sf), "internal", " AN ").select("page_id", "idx", "href"))


@query(RULES + f"SELECT page_id, href, rel FROM ({ADDED_LINKS}) WHERE qualified")
def nofollow_links(spark, sf):
    return A.filter_links(_links(spark, sf), "nofollow").select("page_id", "href", "rel")


def _images(spark, sf, boxes=True):
    rows = X.children(X.page_records(FX.enriched(spark, sf), "images"), "images")
    return A.image_flags(X.with_boxes(rows, FX.render_boxes(spark, sf), "img") if boxes else rows)


IMAGES = f"""SELECT p AS page_id, CAST(0 AS BIGINT) AS idx, {SITE} || '/logo.png' AS src, '/logo.png' AS raw, 'Logo' AS alt, 'L' AS title, '' AS loading, false AS srcset, NULL AS width, NULL AS shown FROM e
    UNION ALL SELECT p, 1, CASE p % 4 WHEN 0 THEN {SITE} || '/a.png' WHEN 1 THEN {SITE} || '/b.png' WHEN 2 THEN {SITE} || '/en/c.png' ELSE 'https://cdn.example.net/d.png' END,
      CASE p % 4 WHEN 0 THEN '/a.png' WHEN 1 THEN '/b.png' WHEN 2 THEN 'c.png' ELSE '//cdn.example.net/d.png' END,
      CASE p % 4 WHEN 1 THEN '' WHEN 2 THEN 'C' WHEN 3 THEN ' ' END, CASE p % 4 WHEN 2 THEN 'See' END, CASE p % 4 WHEN 3 THEN 'lazy' ELSE '' END, p % 4 = 3, 400 + p % 5 * 200, p % 6 <> 0 FROM e"""
FLAGS = f"""SELECT *, alt IS NULL AS missing_alt, coalesce(trim(alt) = '', false) AS empty_alt, coalesce(title, '') = '' AS missing_title, loading = 'lazy' AS lazy,
    coalesce(width > 600 AND width - 300 > 300, false) AS oversized FROM ({IMAGES})"""


@query(RULES + f"SELECT page_id, idx, src, raw, alt, title, loading, srcset, missing_alt, empty_alt, missing_title, lazy, oversized FROM ({FLAGS})")
def image_flags(spark, sf):
    c = ["page_id", "idx", "src", "raw", "alt", "title", "loading", "srcset", "missing_alt", "empty_alt", "missing_title", "lazy", "oversized"]
    return longs(_images(spark, sf).select(*c))


@query(RULES + f"""SELECT page_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (missing_alt) AS BIGINT) AS missing_alt, CAST(count(*) FILTER (empty_alt) AS BIGINT) AS empty_alt,
    CAST(count(*) FILTER (missing_title) AS BIGINT) AS missing_title, CAST(count(*) FILTER (lazy) AS BIGINT) AS lazy, CAST(count(*) FILTER (oversized) AS BIGINT) AS oversized FROM ({FLAGS}) GROUP BY page_id""")
def image_stats(spark, sf):
    return A.image_stats_by_page(_images(spark, sf))


@query(RULES + f"SELECT page_id, idx FROM ({FLAGS}) WHERE oversized")
def oversized_images(spark, sf):
    return longs(A.filter_images(_images(spark, sf), "oversized").select("page_id", "idx"))


@query(RULES + f"SELECT page_id, idx, CASE WHEN idx = 0 THEN 'logo.png' ELSE regexp_extract(src, '([^/]*)$', 1) END AS file_name FROM ({FLAGS})")
def image_file_names(spark, sf):
    return longs(_images(spark, sf, False).select("page_id", "idx", T.file_name(F.col("src")).alias("file_name")))


OG_KEYS = "['og:title', 'og:description', 'og:image', 'og:url', 'og:type']"


@query(RULES + f"SELECT p AS page_id, array_to_string(list_concat(list_slice({OG_KEYS}, 1, p % 5), CASE WHEN p % 3 = 0 THEN ['twitter:card'] ELSE [] END), '|') AS missing FROM e")
def missing_social(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "og", "twitter")
    return r.select("page_id", F.array_join(A.missing_social(F.col("og"), F.col("twitter")), "|").alias("missing"))


@query(RULES + f"""SELECT p AS page_id, 'og' AS vocab, CAST(i - p % 5 AS BIGINT) AS idx, CASE i WHEN 4 THEN 'OG:type' ELSE {OG_KEYS}[i + 1] END AS key,
      CASE i WHEN 0 THEN 'Card ' || p WHEN 1 THEN 'Card & text' WHEN 2 THEN '/img/' || p || '.png' WHEN 3 THEN url ELSE 'article' END AS value
    FROM (SELECT *, unnest(range(5)) AS i FROM e) WHERE i >= p % 5 UNION ALL SELECT p, 'twitter', 0, 'twitter:card', 'summary' FROM e WHERE p % 3 <> 0""")
def social_pairs(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "og", "twitter")
    side = lambda v: X.children(r, v).select("page_id", F.lit(v).alias("vocab"), "idx", "key", "value")
    return longs(side("og").unionByName(side("twitter")))


@query(RULES + f"""SELECT p AS page_id, 's' || (p % 7) || '.example.com' AS og_site, CASE WHEN p % 5 = 0 THEN 'Card ' || p ELSE {TITLE} END AS og_title,
    CASE WHEN p % 5 <= 1 THEN 'Card & text' ELSE coalesce({DESC}, '') END AS og_description, CASE WHEN p % 5 <= 2 THEN {SITE} || '/img/' || p || '.png' END AS og_image,
    CASE WHEN p % 3 <> 0 THEN 'summary' END AS twitter_card, CASE WHEN p % 5 = 0 THEN 'Card ' || p ELSE {TITLE} END AS twitter_title,
    CASE WHEN p % 5 <= 1 THEN 'Card & text' ELSE coalesce({DESC}, '') END AS twitter_description, CASE WHEN p % 5 <= 2 THEN {SITE} || '/img/' || p || '.png' END AS twitter_image,
    p % 3 = 0 AND p % 5 <= 2 AS large_card FROM e""")
def social_cards(spark, sf):
    return A.social_card(X.page_records(FX.enriched(spark, sf), "head", "og", "twitter"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN 'failed' WHEN w >= 1200 AND abs(w / h - 1.91) < 0.15 THEN 'ok' WHEN w < 600 THEN 'too small' ELSE 'aim for 1200x630' END AS size_class
    FROM (SELECT p_partkey, p_size, 400 + p_partkey % 9 * 150 AS w, 600.0 + p_partkey % 4 * 40 AS h FROM part)""")
def social_image_sizes(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", F.expr("cast(400 + p_partkey % 9 * 150 as int)").alias("w"), F.expr("cast(600 + p_partkey % 4 * 40 as int)").alias("h"))
    return df.select(F.col("p_partkey").alias("k"), A.image_size_class(F.col("w"), F.col("h"), F.col("p_size") % 7 == 0).alias("size_class"))


@query(RULES + """SELECT p AS page_id, false AS url_too_long, false AS lang_missing, p % 3 = 0 AS viewport_missing, p % 11 = 0 AS meta_refresh, false AS multiple_titles, p % 4 = 2 AS multiple_descriptions FROM e""")
def page_flags(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "head")
    return r.select("page_id", *A.page_flags(F.col("head"), F.col("url")))


@query("""SELECT CAST(code AS BIGINT) AS code, CASE code WHEN 200 THEN 'OK' WHEN 201 THEN 'Created' WHEN 202 THEN 'Accepted' WHEN 203 THEN 'Non-Authoritative' WHEN 204 THEN 'No Content' WHEN 206 THEN 'Partial Content'
      WHEN 301 THEN 'Moved Permanently' WHEN 302 THEN 'Found' WHEN 303 THEN 'See Other' WHEN 304 THEN 'Not Modified' WHEN 307 THEN 'Temporary Redirect' WHEN 308 THEN 'Permanent Redirect' ELSE '' END AS reason,
    CASE WHEN code < 300 THEN 'good' ELSE 'warn' END AS class, CAST(count(*) AS BIGINT) AS n FROM (SELECT 200 + page_id % 120 AS code FROM pages) GROUP BY 1, 2, 3""")
def http_status_texts(spark, sf):
    df = FX.pages(spark, sf).select((F.lit(200) + F.col("page_id") % 120).alias("code"))
    return df.groupBy("code", T.status_text(F.col("code")).alias("reason"), T.status_class(F.col("code")).alias("class")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- robots.txt

FILES = "WITH k AS (SELECT DISTINCT page_id % 7 AS k FROM pages), f AS (SELECT 'https://s' || k || '.example.com' AS origin FROM k WHERE k NOT IN (1, 2, 3)) "


@query(FILES + """SELECT origin, a.g AS group_no, a.agent, a.type, a.path, a.line FROM (SELECT origin, unnest([
    {'g': 1::BIGINT, 'agent': '*', 'type': 'disallow', 'path': '/private', 'line': 'Disallow: /private'},
    {'g': 2, 'agent': 'googlebot', 'type': 'disallow', 'path': '/en/1', 'line': 'Disallow: /en/1'}, {'g': 2, 'agent': 'bingbot', 'type': 'disallow', 'path': '/en/1', 'line': 'Disallow: /en/1'},
    {'g': 2, 'agent': 'googlebot', 'type': 'allow', 'path': '/en/12', 'line': 'Allow: /en/12'}, {'g': 2, 'agent': 'bingbot', 'type': 'allow', 'path': '/en/12', 'line': 'Allow: /en/12'},
    {'g': 2, 'agent': 'googlebot', 'type': 'disallow', 'path': '/*5$', 'line': 'Disallow: /*5$'}, {'g': 2, 'agent': 'bingbot', 'type': 'disallow', 'path': '/*5$', 'line': 'Disallow: /*5$'},
    {'g': 2, 'agent': 'googlebot', 'type': 'disallow', 'path': '', 'line': 'Disallow:'}, {'g': 2, 'agent': 'bingbot', 'type': 'disallow', 'path': '', 'line': 'Disallow:'},
    {'g': 3, 'agent': 'gptbot', 'type': 'disallow', 'path': '/', 'line': 'Disallow: /'}]) AS a FROM f)""")
def robots_rules(spark, sf):
    return longs(R.robots_rules(FX.robots_files(spark, sf)).drop("rule_no"))


@query(FILES + "SELECT origin, unnest(['https://s.example.com/a.xml', 'https://s.example.com/b.xml']) AS sitemap FROM f")
def robots_sitemaps(spark, sf):
    return R.robots_sitemaps(FX.robots_files(spark, sf)).drop("line_no")


@query(RULES + """SELECT p AS page_id, '' || p LIKE '1%' AS prefix, '' || p LIKE '%5' AS anchored, regexp_matches('/en/' || p, '^/e.*2') AS wildcard, false AS case_sensitive FROM e""")
def robots_rule_matches(spark, sf):
    df = FX.enriched(spark, sf).select("page_id", U.path_and_query(F.col("url")).alias("path"))
    m = lambda p: R.matches_rule(F.lit(p), F.col("path"))
    return df.select("page_id", m("/en/1").alias("prefix"), m("/*5$").alias("anchored"), m("/e*2").alias("wildcard"), m("/EN/").alias("case_sensitive"))


@query(RULES + f"""SELECT p AS page_id, {ALLOWED} AS allowed, p % 7 = 2 AS server_error, CASE WHEN p % 7 NOT IN (1, 2, 3) THEN {PATH_RULE} END AS rule,
    CASE WHEN p % 7 NOT IN (1, 2, 3) THEN 'googlebot' END AS "group" FROM e""")
def robots_check(spark, sf):
    c = R.check_urls(FX.enriched(spark, sf), FX.robots_files(spark, sf))
    return c.select("page_id", "allowed", "server_error", "rule", "group")


@query(RULES + """SELECT p AS page_id, p % 3 <> 0 AS allowed, CASE WHEN p % 3 = 0 THEN 'Disallow' ELSE 'Allow' END || ': /en/' || p || '$' AS rule FROM e""")
def robots_large_files(spark, sf):
    """Files of ten thousand rules and more: one for each page of the crawl, and as many for other addresses."""
    pages = FX.enriched(spark, sf)
    rule = F.expr("concat(if(page_id % 3 = 0, 'Disallow', 'Allow'), ': /en/', page_id, '$')")
    of_pages = pages.select(U.origin_of(F.col("url")).alias("origin"), rule.alias("rule"))
    others = pages.select(U.origin_of(F.col("url")).alias("origin")).distinct().select("origin", F.explode(F.expr("transform(sequence(1, 10000), n -> concat('Disallow: /other/', n, '*x'))")).alias("rule"))
    lines = of_pages.unionByName(others).groupBy("origin").agg(F.collect_list("rule").alias("rules"))
    body = F.concat(F.lit("User-agent: *\nDisallow: /en/1\n"), F.array_join("rules", "\n"))
    files = lines.select("origin", F.lit(200).alias("status"), body.alias("body"), F.lit(None).cast("string").alias("error"))
    return R.check_urls(pages, files).select("page_id", "allowed", "rule")


@query(RULES + f"""SELECT p AS page_id, agent, CASE p % 7 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN NULL ELSE
      CASE WHEN agent IN ('googlebot', 'bingbot') THEN coalesce({PATH_RULE} NOT LIKE 'Dis%', true) WHEN agent = 'gptbot' THEN false ELSE true END END AS allowed
    FROM (SELECT *, unnest(['googlebot', 'bingbot', 'gptbot', 'claudebot', 'perplexitybot']) AS agent FROM e)""")
def crawler_access(spark, sf):
    c = R.check_urls(FX.enriched(spark, sf), FX.robots_files(spark, sf), R.CRAWLERS)
    return c.select("page_id", "agent", "allowed")


# ---------------------------------------------------------------- hreflang

PARTNER = "CASE WHEN p % 2 = 0 THEN p + 1 ELSE p - 1 END"
ENTRIES = f"""SELECT p, url, q, a.lang, a.href, a.raw, a.source FROM (SELECT p, url, q, unnest(list_concat(CASE WHEN p % 4 < 2 THEN list_concat(list_concat(list_concat(
      [{{'lang': 'en', 'href': url, 'raw': url, 'source': 'html'}}],
      CASE WHEN p % 7 = 0 THEN [] ELSE [{{'lang': 'fr', 'href': CASE WHEN p % 10 = 0 THEN {SITE} || '/en/' || q ELSE 'https://s' || (q % 7) || '.example.com/en/' || q END,
        'raw': CASE WHEN p % 10 = 0 THEN '/en/' || q ELSE 'https://s' || (q % 7) || '.example.com/en/' || q END, 'source': 'html'}}] END),
      CASE WHEN p % 12 = 0 THEN [] ELSE [{{'lang': 'x-default', 'href': url, 'raw': url, 'source': 'html'}}] END),
      CASE WHEN p % 9 = 0 THEN [{{'lang': 'en_GB', 'href': url, 'raw': url, 'source': 'html'}}] ELSE [] END) ELSE [] END,
      CASE WHEN p % 6 = 5 AND p % 17 <> 0 THEN [{{'lang': 'de', 'href': 'https://alt.example.org/' || p, 'raw': 'https://alt.example.org/' || p, 'source': 'header'}}] ELSE [] END)) AS a
    FROM (SELECT *, {PARTNER} AS q FROM e))"""
# t is the page an entry points to: itself, its partner, or nobody in the crawl. Pages with t % 10 = 3 answer elsewhere,
# outside the crawl; half of those answers have a body, which names the page itself.
CHECKED = f"""SELECT *, CASE WHEN t IS NOT NULL AND t % 17 <> 0 THEN CASE WHEN t % 10 = 0 THEN 404 ELSE 200 END END AS status,
      CASE WHEN t IS NULL OR t % 17 = 0 THEN NULL
        WHEN t % 10 = 3 AND t % 9 <> 4 THEN CASE WHEN t % 20 = 3 THEN t = p END
        WHEN t % 10 <> 0 AND t % 9 <> 4 THEN t = p OR (t % 4 < 2 AND t % 7 <> 0 AND t % 10 <> 0)
        WHEN t % 6 = 5 THEN false END AS return_link
    FROM (SELECT *, CASE WHEN lang IN ('en', 'x-default', 'en_GB') THEN p WHEN lang = 'fr' AND p % 10 <> 0 AND q <= (SELECT max(page_id) FROM pages) THEN q END AS t FROM ({ENTRIES}))"""


def _hreflang(spark, sf):
    r = skew.staged(X.page_records(FX.enriched(spark, sf), "head", "hreflang"))
    return r, FX.responses(spark, sf)


@query(RULES + f"SELECT p AS page_id, lang, href, raw FROM ({ENTRIES}) WHERE source = 'html'")
def hreflang_tags(spark, sf):
    return X.children(X.page_records(FX.enriched(spark, sf), "hreflang"), "hreflang").select("page_id", "lang", "href", "raw")


@query(RULES + f"SELECT p AS page_id, lang, href, raw, source FROM ({ENTRIES})")
def hreflang_entries(spark, sf):
    r, resp = _hreflang(spark, sf)
    return HL.hreflang_entries(HL.page_alternates(r, resp)).select("page_id", "lang", "href", "raw", "source")


@query(RULES + "SELECT p AS page_id, u AS url, rel, hreflang FROM (SELECT p, 'https://alt.example.org/' || p AS u, 'alternate' AS rel, 'de' AS hreflang FROM e WHERE p % 6 = 5 UNION ALL SELECT p, '/x.css', 'preload', NULL FROM e WHERE p % 6 = 5)")
def link_headers(spark, sf):
    r = FX.responses(spark, sf).select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("page_id"), F.explode(D.parse_link_header(F.col("headers.Link"))).alias("l"))
    return r.select("page_id", "l.url", "l.rel", "l.hreflang")


@query(RULES + f"SELECT p AS page_id, lang, lang <> 'en_GB' AS valid FROM ({ENTRIES}) WHERE source = 'html'")
def hreflang_codes(spark, sf):
    rows = X.children(X.page_records(FX.enriched(spark, sf), "hreflang"), "hreflang")
    return rows.select("page_id", "lang", A.valid_hreflang(F.col("lang")).alias("valid"))


@query(RULES + """SELECT p AS page_id, array_to_string(list_filter([CASE WHEN p % 12 = 0 THEN 'No x-default' END, CASE WHEN p % 10 = 0 AND p % 7 <> 0 THEN 'Relative URL for fr' END,
    CASE WHEN p % 9 = 0 THEN 'Invalid code "en_GB"' END], lambda x: x IS NOT NULL), '|') AS issues FROM e WHERE p % 4 < 2""")
def hreflang_issues(spark, sf):
    r = X.page_records(FX.enriched(spark, sf), "hreflang").where(F.size("hreflang") > 0)
    texts = F.transform(A.hreflang_issues(F.col("hreflang"), F.col("url")), lambda i: i["text"])
    return r.select("page_id", F.array_join(texts, "|").alias("issues"))


@query(RULES + f"SELECT p AS page_id, lang, CAST(status AS BIGINT) AS status, return_link FROM ({CHECKED})")
def hreflang_checks(spark, sf):
    r, resp = _hreflang(spark, sf)
    return longs(HL.checked_alternates(r, resp).select("page_id", "lang", "status", "return_link"))


@query(RULES + f"""SELECT p AS page_id, lang, CASE WHEN t % 17 = 0 THEN 'Failed' WHEN t % 10 = 3 THEN '3xx → ' || status ELSE '' || status END AS status_label,
    CASE WHEN t % 17 = 0 THEN NULL WHEN href = url THEN 'This page' WHEN return_link THEN 'Links back' WHEN NOT return_link THEN 'No return link' END AS link_label FROM ({CHECKED})""")
def hreflang_report(spark, sf):
    r, resp = _hreflang(spark, sf)
    return HL.hreflang_report(r, resp).select("page_id", "lang", "status_label", "link_label")


@query(RULES + f"""SELECT p AS page_id, lang, href, source, CAST(status AS BIGINT) AS status, CASE WHEN return_link THEN 'yes' WHEN NOT return_link THEN 'no' ELSE '' END AS links_back FROM ({CHECKED})""")
def hreflang_export(spark, sf):
    r, resp = _hreflang(spark, sf)
    checked = HL.checked_alternates(r, resp)
    return longs(export.hreflang_export(checked).select("page_id", "lang", "href", "source", "status", "links_back"))


# ---------------------------------------------------------------- trackers


def _signals(spark, sf):
    return X.staged_signals(FX.enriched(spark, sf))


TRACKED = """SELECT p, CASE p % 8 WHEN 0 THEN 'gtm' WHEN 1 THEN 'ga4' WHEN 2 THEN 'meta' WHEN 3 THEN 'hotjar' WHEN 4 THEN 'clarity' WHEN 5 THEN 'plausible' WHEN 6 THEN 'linkedin' ELSE 'onetrust' END AS tracker,
    CASE p % 8 WHEN 0 THEN 'GTM-K' || lpad('' || p, 6, '0') WHEN 1 THEN 'G-Q' || lpad('' || p, 7, '0') WHEN 2 THEN '' || (900000000000000 + p) WHEN 3 THEN '' || (70000 + p)
      WHEN 4 THEN 'ab' || lpad('' || p, 8, '0') WHEN 5 THEN 'site' || p || '.example.com' WHEN 6 THEN '' || (5000 + p) END AS id FROM e"""


@query(RULES + f"SELECT p AS page_id, tracker, id, 'in-page' AS status FROM ({TRACKED}) WHERE p % 16 NOT IN (8, 9)")
def trackers_in_page(spark, sf):
    return TR.detect_trackers(_signals(spark, sf)).select("page_id", "tracker", "id", "status")


FULL_TRACKERS = f"""SELECT p AS page_id, tracker, id, CASE WHEN p % 8 = 1 THEN 'sending' WHEN p % 8 IN (0, 5, 7) OR p % 16 = 10 THEN 'loaded' ELSE 'in-page' END AS status FROM ({TRACKED})
    UNION ALL SELECT p, 'ga4', 'G-C' || lpad('' || p, 7, '0'), 'gtm-only' FROM e WHERE p % 8 = 0 UNION ALL SELECT p, 'hotjar', NULL, 'gtm-only' FROM e WHERE p % 8 = 0
    UNION ALL SELECT p, 'meta', '' || (800000000000000 + p), 'gtm-only' FROM e WHERE p % 8 = 0"""


def _trackers(spark, sf):
    return TR.detect_trackers(_signals(spark, sf), FX.page_requests(spark, sf), FX.runtime_state(spark, sf), FX.containers(spark, sf))


@query(RULES + FULL_TRACKERS)
def tracker_status(spark, sf):
    return _trackers(spark, sf).select("page_id", "tracker", "id", "status")


@query(RULES + f"""SELECT page_id, tracker, id, CASE status WHEN 'sending' THEN 'Sending' WHEN 'in-page' THEN 'In the page, not loaded' WHEN 'gtm-only' THEN 'In GTM only'
    ELSE CASE WHEN tracker IN ('gtm', 'onetrust') THEN 'Loaded' ELSE 'Loaded, not sending' END END AS status_label FROM ({FULL_TRACKERS})""")
def tracker_labels(spark, sf):
    return TR.status_label(_trackers(spark, sf)).select("page_id", "tracker", "id", "status_label")


@query(RULES + f"SELECT page_id, status, CAST(count(*) AS BIGINT) AS n FROM ({FULL_TRACKERS}) GROUP BY 1, 2")
def tracker_status_counts(spark, sf):
    return TR.status_counts(_trackers(spark, sf))


@query(RULES + f"""SELECT page_id, CASE WHEN tracker = 'meta' THEN 'meta|' || id ELSE tracker END AS key, CASE tracker WHEN 'meta' THEN 'Meta Pixel ' || id WHEN 'gtm' THEN 'GTM' WHEN 'ga4' THEN 'GA4' WHEN 'hotjar' THEN 'Hotjar'
    WHEN 'clarity' THEN 'Clarity' WHEN 'plausible' THEN 'Plausible' WHEN 'linkedin' THEN 'LinkedIn' ELSE 'OneTrust' END AS label, status FROM ({FULL_TRACKERS})""")
def tracker_chips(spark, sf):
    return TR.tracker_chips(_trackers(spark, sf)).select("page_id", "key", "label", "status")


@query(RULES + f"""SELECT p AS page_id, CASE p % 8 WHEN 0 THEN 'Google Tag Manager: ' || id || chr(10) || 'Google Analytics 4: G-C' || lpad('' || p, 7, '0') || chr(10) || 'Hotjar: ID set by a GTM variable' || chr(10) || 'Meta Pixel: ' || (800000000000000 + p)
    WHEN 1 THEN 'Google Analytics 4: ' || id WHEN 2 THEN 'Meta Pixel: ' || id WHEN 3 THEN 'Hotjar: ' || id WHEN 4 THEN 'Microsoft Clarity: ' || id WHEN 5 THEN 'Plausible: ' || id WHEN 6 THEN 'LinkedIn Insight Tag: ' || id
    ELSE 'OneTrust' END AS trackers FROM ({TRACKED})""")
def tracker_list(spark, sf):
    return export.tracker_list(_trackers(spark, sf))


# Container, code, request and runtime evidence of the enriched pages; placeholders on pages 8 and 9 of sixteen.
EVIDENCE = """SELECT p AS page_id, a.tracker, a.label, a.kind, a.id FROM (SELECT p, unnest(list_filter([
    CASE WHEN p % 8 = 0 THEN {'tracker': 'ga4', 'label': 'GA4 ID in GTM-K' || lpad('' || p, 6, '0'), 'kind': 'container', 'id': 'G-C' || lpad('' || p, 7, '0')} END,
    CASE WHEN p % 8 = 0 THEN {'tracker': 'gtm', 'label': 'gtm.js loaded', 'kind': 'loaded', 'id': 'GTM-K' || lpad('' || p, 6, '0')} END,
    CASE WHEN p % 8 = 0 THEN {'tracker': 'hotjar', 'label': 'Hotjar tag in GTM-K' || lpad('' || p, 6, '0'), 'kind': 'container', 'id': NULL} END,
    CASE WHEN p % 8 = 0 THEN {'tracker': 'meta', 'label': 'fbq init in GTM-K' || lpad('' || p, 6, '0'), 'kind': 'container', 'id': '' || (800000000000000 + p)} END,
    CASE WHEN p % 8 = 1 THEN {'tracker': 'ga4', 'label': 'hit to /g/collect', 'kind': 'hit', 'id': 'G-Q' || lpad('' || p, 7, '0')} END,
    CASE WHEN p % 16 = 1 THEN {'tracker': 'ga4', 'label': 'inline gtag config', 'kind': 'code', 'id': 'G-Q' || lpad('' || p, 7, '0')} END,
    CASE WHEN p % 8 = 2 THEN {'tracker': 'meta', 'label': CASE WHEN p % 16 = 2 THEN 'fbevents.js requested, never ran (blocked?)' ELSE 'fbevents.js loaded' END, 'kind': CASE WHEN p % 16 = 2 THEN 'code' ELSE 'loaded' END, 'id': NULL} END,
    CASE WHEN p % 8 = 2 THEN {'tracker': 'meta', 'label': 'inline fbq init', 'kind': 'code', 'id': '' || (900000000000000 + p)} END,
    CASE WHEN p % 8 = 2 THEN {'tracker': 'meta', 'label': 'noscript facebook.com/tr', 'kind': 'code', 'id': '' || (900000000000000 + p)} END,
    CASE WHEN p % 8 = 3 THEN {'tracker': 'hotjar', 'label': 'inline Hotjar snippet', 'kind': 'code', 'id': '' || (70000 + p)} END,
    CASE WHEN p % 8 = 4 THEN {'tracker': 'clarity', 'label': 'inline Clarity snippet', 'kind': 'code', 'id': 'ab' || lpad('' || p, 8, '0')} END,
    CASE WHEN p % 8 = 5 THEN {'tracker': 'plausible', 'label': 'plausible.io script loaded', 'kind': 'loaded', 'id': NULL} END,
    CASE WHEN p % 8 = 5 THEN {'tracker': 'plausible', 'label': 'script data-domain', 'kind': 'loaded', 'id': 'site' || p || '.example.com'} END,
    CASE WHEN p % 8 = 6 THEN {'tracker': 'linkedin', 'label': 'inline _linkedin_partner_id', 'kind': 'code', 'id': '' || (5000 + p)} END,
    CASE WHEN p % 8 = 7 THEN {'tracker': 'onetrust', 'label': 'OneTrust object', 'kind': 'loaded', 'id': NULL} END,
    CASE WHEN p % 8 = 7 THEN {'tracker': 'onetrust', 'label': 'OneTrust script script in the page, not loaded', 'kind': 'code', 'id': NULL} END], lambda x: x IS NOT NULL)) AS a FROM e)"""


@query(RULES + EVIDENCE)
def tracker_evidence(spark, sf):
    ev = TR.evidence(_signals(spark, sf), FX.page_requests(spark, sf), FX.runtime_state(spark, sf), FX.containers(spark, sf))
    return ev.select("page_id", "tracker", "label", "kind", "id")


@query(RULES + """SELECT p AS page_id, a.kind, a.tracker, a.part, a.label, a.id FROM (SELECT p, unnest(list_filter([
    CASE WHEN p % 16 = 0 THEN {'kind': 'script', 'tracker': 'gtm', 'part': 'src', 'label': 'gtm.js', 'id': 'GTM-K' || lpad('' || p, 6, '0')} END,
    CASE WHEN p % 16 = 1 THEN {'kind': 'inline', 'tracker': 'ga4', 'part': 'code', 'label': 'gtag config', 'id': 'G-Q' || lpad('' || p, 7, '0')} END,
    CASE WHEN p % 8 = 2 THEN {'kind': 'inline', 'tracker': 'meta', 'part': 'code', 'label': 'fbq init', 'id': '' || (900000000000000 + p)} END,
    CASE WHEN p % 8 = 2 THEN {'kind': 'noscript', 'tracker': 'meta', 'part': 'code', 'label': 'facebook.com/tr', 'id': '' || (900000000000000 + p)} END,
    CASE WHEN p % 8 = 3 THEN {'kind': 'inline', 'tracker': 'hotjar', 'part': 'code', 'label': 'Hotjar snippet', 'id': '' || (70000 + p)} END,
    CASE WHEN p % 8 = 4 THEN {'kind': 'inline', 'tracker': 'clarity', 'part': 'code', 'label': 'Clarity snippet', 'id': 'ab' || lpad('' || p, 8, '0')} END,
    CASE WHEN p % 8 = 5 THEN {'kind': 'script', 'tracker': 'plausible', 'part': 'tag', 'label': 'data-domain', 'id': 'site' || p || '.example.com'} END,
    CASE WHEN p % 8 = 5 THEN {'kind': 'script', 'tracker': 'plausible', 'part': 'src', 'label': 'plausible.io script', 'id': NULL} END,
    CASE WHEN p % 8 = 6 THEN {'kind': 'inline', 'tracker': 'linkedin', 'part': 'code', 'label': '_linkedin_partner_id', 'id': '' || (5000 + p)} END,
    CASE WHEN p % 8 = 7 THEN {'kind': 'script', 'tracker': 'onetrust', 'part': 'src', 'label': 'OneTrust script', 'id': NULL} END], lambda x: x IS NOT NULL)) AS a FROM e)""")
def tracker_matches(spark, sf):
    return TR.tracker_matches(_signals(spark, sf)).select("page_id", "kind", "tracker", "part", "label", "id")


@query(RULES + """SELECT p AS page_id, CAST(CASE p % 8 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END + p % 2 AS BIGINT) AS scripts,
    CAST(1 + CASE p % 8 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS BIGINT) AS inline, CAST(CASE p % 8 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS noscript,
    CAST(1 + CASE WHEN p % 8 IN (0, 1, 2, 5) THEN 1 ELSE 0 END AS BIGINT) AS resources, false AS capped, p % 16 = 2 OR p % 8 IN (3, 7) AS live FROM e""")
def tracker_coverage(spark, sf):
    return TR.coverage(_signals(spark, sf), FX.page_requests(spark, sf), FX.runtime_state(spark, sf))


@query(RULES + "SELECT p AS page_id, 'GTM-K' || lpad('' || p, 6, '0') AS id, 'https://www.googletagmanager.com/gtm.js?id=GTM-K' || lpad('' || p, 6, '0') AS url FROM e WHERE p % 8 = 0")
def container_targets(spark, sf):
    return K.container_targets(_signals(spark, sf), FX.page_requests(spark, sf), _trackers(spark, sf))


@query(RULES + """SELECT 'GTM-K' || lpad('' || p, 6, '0') AS container_id, a.tracker, a.id, a.label, a.variable FROM (SELECT p, unnest([
    {'tracker': 'ga4', 'id': 'G-C' || lpad('' || p, 7, '0'), 'label': 'GA4 ID', 'variable': false}, {'tracker': 'meta', 'id': '' || (800000000000000 + p), 'label': 'fbq init', 'variable': false},
    {'tracker': 'hotjar', 'id': NULL, 'label': 'Hotjar tag', 'variable': true}]) AS a FROM e WHERE p % 8 = 0)""")
def container_scan(spark, sf):
    return K.scan_containers(K.read_containers(FX.containers(spark, sf)))


@query(RULES + "SELECT 'GTM-K' || lpad('' || p, 6, '0') AS container_id, 'G-C' || lpad('' || p, 7, '0') AS constant FROM e WHERE p % 8 = 0")
def container_constants(spark, sf):
    c = FX.containers(spark, sf).select("container_id", K.container_data(F.col("text")).alias("j"))
    return c.select("container_id", F.get_json_object("j", "$.resource.macros[0].vtp_value").alias("constant"))


@query("""SELECT page_id, id, regexp_matches(id, '^G-[A-Z0-9]{6,12}$') AND page_id % 4 NOT IN (1, 2) AS valid FROM (SELECT page_id,
    CASE page_id % 4 WHEN 0 THEN 'G-AB' || lpad('' || page_id, 6, '0') WHEN 1 THEN 'G-XXXXXXXX' WHEN 2 THEN 'G-1234567' || page_id % 9 ELSE 'G-ab' || page_id END AS id FROM pages)""")
def tracker_id_validity(spark, sf):
    id_ = F.expr("case page_id % 4 when 0 then concat('G-AB', lpad(page_id, 6, '0')) when 1 then 'G-XXXXXXXX' when 2 then concat('G-1234567', page_id % 9) else concat('G-ab', page_id) end")
    return FX.pages(spark, sf).select("page_id", id_.alias("id")).select("page_id", "id", TR.valid_id(F.col("id"), F.lit("G-[A-Z0-9]{6,12}"), ["G-[A-Z0-9]{6,12}"]).alias("valid"))


# ---------------------------------------------------------------- technologies


def _tech(spark, sf, full=False):
    pages = FX.enriched(spark, sf)
    headers = TE.page_headers(pages, FX.responses(spark, sf))
    probes = cms.accepted_probes(FX.probes(spark, sf), pages) if full else None
    return cms.detect(_signals(spark, sf), headers=headers, probes=probes)


TECH_ROWS = """SELECT p AS page_id, a.tech, a.version, a.confidence, a.implied FROM (SELECT p, unnest(list_filter([
    CASE WHEN p % 8 = 0 THEN {'tech': 'wordpress', 'version': '6.9.4', 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 8 = 0 THEN {'tech': 'woocommerce', 'version': '8.' || p % 3, 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 8 = 1 THEN {'tech': 'nextjs', 'version': NULL, 'confidence': NULL, 'implied': false} END, CASE WHEN p % 8 = 1 THEN {'tech': 'react', 'version': NULL, 'confidence': NULL, 'implied': true} END,
    CASE WHEN p % 8 = 2 THEN {'tech': 'drupal', 'version': '10', 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 8 = 3 THEN {'tech': 'jquery', 'version': '3.' || p % 7 || '.1', 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 8 = 4 THEN {'tech': 'wordpress', 'version': NULL, 'confidence': NULL, 'implied': true} END,
    CASE WHEN p % 8 = 6 THEN {'tech': 'ghost', 'version': '5.82', 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 17 <> 0 AND p % 5 = 0 THEN {'tech': 'nginx', 'version': '1.25.3', 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 17 <> 0 AND p % 5 = 1 THEN {'tech': 'cloudflare', 'version': NULL, 'confidence': NULL, 'implied': false} END,
    CASE WHEN p % 17 <> 0 AND p % 5 = 2 THEN {'tech': 'apache', 'version': NULL, 'confidence': NULL, 'implied': false} END,
    CASE WHEN p % 17 <> 0 AND p % 4 = 0 THEN {'tech': 'php', 'version': '8.2.1', 'confidence': 'confirmed', 'implied': false} END,
    CASE WHEN p % 17 <> 0 AND p % 4 = 0 THEN {'tech': 'express', 'version': NULL, 'confidence': NULL, 'implied': false} END], lambda x: x IS NOT NULL)) AS a FROM e)"""


@query(RULES + TECH_ROWS)
def technologies(spark, sf):
    return _tech(spark, sf)["tech"].select("page_id", "tech", "version", "confidence", "implied")


@query(RULES + """SELECT p AS page_id, 'wordpress' AS tech, 'generator "WordPress 6.9.4"' AS text, '6.9.4' AS version, CAST(1 AS BIGINT) AS rank FROM e WHERE p % 8 = 0
    UNION ALL SELECT p, 'wordpress', 'wp-content/ asset: ' || x, NULL, 5 FROM (SELECT p, unnest(['/wp-content/plugins/contact-form-7/index.js?ver=5.9', '/wp-content/plugins/acme-tools/a.js?ver=2.1', '/wp-content/plugins/woocommerce/b.js?ver=8.' || p % 3, '/wp-content/themes/acme-child/style.css?ver=1.2.0']) AS x FROM e WHERE p % 8 = 0)
    UNION ALL SELECT p, 'drupal', 'generator "Drupal 10 (https://www.drupal.org)"', '10', 1 FROM e WHERE p % 8 = 2
    UNION ALL SELECT p, 'jquery', 'jquery-X.js: /jquery-3.' || p % 7 || '.1.min.js', '3.' || p % 7 || '.1', 5 FROM e WHERE p % 8 = 3
    UNION ALL SELECT p, 'nextjs', '/_next/static/ asset: /_next/static/chunks/main.js', NULL, 5 FROM e WHERE p % 8 = 1
    UNION ALL SELECT p, 'yoast', 'comment "This site is optimized with the Yoast SEO plugin v22.5 - https://example.com"', '22.5', 4 FROM e WHERE p % 8 = 4
    UNION ALL SELECT p, 'ghost', 'generator "Ghost 5.82"', '5.82', 1 FROM e WHERE p % 8 = 6
    UNION ALL SELECT p, a.t, a.x, a.v, 3 FROM (SELECT p, unnest(list_filter([CASE WHEN p % 5 = 0 THEN {'t': 'nginx', 'x': 'server: nginx/1.25.3', 'v': '1.25.3'} END, CASE WHEN p % 5 = 1 THEN {'t': 'cloudflare', 'x': 'server: cloudflare', 'v': NULL} END,
        CASE WHEN p % 5 = 2 THEN {'t': 'apache', 'x': 'server: Apache', 'v': NULL} END, CASE WHEN p % 4 = 0 THEN {'t': 'php', 'x': 'x-powered-by: PHP/8.2.1, Express', 'v': '8.2.1'} END,
        CASE WHEN p % 4 = 0 THEN {'t': 'express', 'x': 'x-powered-by: PHP/8.2.1, Express', 'v': NULL} END], lambda x: x IS NOT NULL)) AS a FROM e WHERE p % 17 <> 0)
    UNION ALL SELECT p, 'jquery', 'jQuery.fn.jquery = 3.7.1', '3.7.1', 2 FROM e WHERE p % 8 = 3""")
def tech_evidence(spark, sf):
    headers = TE.page_headers(FX.enriched(spark, sf), FX.responses(spark, sf))
    ev = TE.base_evidence(_signals(spark, sf), headers=headers, runtime=FX.runtime_state(spark, sf))
    return longs(ev.select("page_id", "tech", "text", "version", "rank"))


@query(RULES + """SELECT p AS page_id, 'plugins' AS kind, a.s AS slug, a.v AS ver FROM (SELECT p, unnest([{'s': 'contact-form-7', 'v': '5.9'}, {'s': 'acme-tools', 'v': '2.1'}, {'s': 'woocommerce', 'v': '8.' || p % 3}]) AS a FROM e WHERE p % 8 = 0)
    UNION ALL SELECT p, 'themes', 'acme-child', '1.2.0' FROM e WHERE p % 8 = 0""")
def cms_assets(spark, sf):
    s = _signals(spark, sf)
    return cms.asset_paths(s, TE.page_urls(s)).select("page_id", "kind", "slug", "ver")


@query(RULES + f"""SELECT p AS page_id, 'acme-child' AS slug, 'Acme Child' AS name, '1.4' AS version, 'acme' AS parent, true AS child, {SITE} || '/wp-content/themes/acme-child/' AS base, 'acme-child' AS wporg FROM e WHERE p % 8 = 0""")
def cms_themes(spark, sf):
    return _tech(spark, sf, True)["themes"].select("page_id", "slug", "name", "version", "parent", "child", "base", "wporg")


PLUGINS = """SELECT p AS page_id, a.id, a.slug, a.name, a.named, a.version, a.wporg, CAST(a.n AS BIGINT) AS row_no FROM (SELECT p, unnest([
    {'id': 'cf7', 'slug': 'contact-form-7', 'name': 'Contact Form 7', 'named': true, 'version': '5.9', 'wporg': 'contact-form-7', 'n': 1},
    {'id': 'yoast', 'slug': 'wordpress-seo', 'name': 'Yoast SEO', 'named': true, 'version': NULL, 'wporg': 'wordpress-seo', 'n': 2},
    {'id': 'slug:acme-tools', 'slug': 'acme-tools', 'name': 'acme-tools', 'named': false, 'version': '2.1', 'wporg': 'acme-tools', 'n': 3}]) AS a FROM e WHERE p % 8 = 0)
    UNION ALL SELECT p, 'yoast', 'wordpress-seo', 'Yoast SEO', true, '22.5', 'wordpress-seo', 1 FROM e WHERE p % 8 = 4"""


@query(RULES + PLUGINS)
def cms_plugins(spark, sf):
    return longs(_tech(spark, sf, True)["plugins"].select("page_id", "id", "slug", "name", "named", "version", "wporg", "row_no"))


@query(RULES + """SELECT p AS page_id, a.ns, a.tech, a.core FROM (SELECT p, unnest([{'ns': 'oembed/1.0', 'tech': NULL, 'core': true}, {'ns': 'wp/v2', 'tech': NULL, 'core': true},
    {'ns': 'contact-form-7/v1', 'tech': 'cf7', 'core': false}, {'ns': 'acme/v1', 'tech': NULL, 'core': false}, {'ns': 'yoast/v1', 'tech': 'yoast', 'core': false}]) AS a FROM e WHERE p % 8 = 0)""")
def cms_namespaces(spark, sf):
    return cms.namespace_plugins(cms.namespaces(FX.probes(spark, sf))).select("page_id", "ns", "tech", "core")


@query(RULES + "SELECT p AS page_id, unnest(['feed', 'opml']) AS kind, unnest(['6.9.4', '6.1']) AS version FROM e WHERE p % 8 = 0")
def cms_core_versions(spark, sf):
    return cms.probe_core_versions(FX.probes(spark, sf))


@query(RULES + "SELECT p AS page_id, unnest(['feed', 'rest', 'theme']) AS kind, unnest(['Feed', 'REST namespaces', 'Theme acme-child style.css']) AS label, true AS ok FROM e WHERE p % 8 = 0")
def probe_statuses(spark, sf):
    kept = cms.accepted_probes(FX.probes(spark, sf), FX.enriched(spark, sf))
    return cms.probe_status(kept).select("page_id", "kind", "label", "ok")


@query(RULES + f"SELECT p AS page_id, 'theme' AS kind, 'acme-child' AS slug, {SITE} || '/wp-content/themes/acme-child/style.css' AS url FROM e WHERE p % 8 = 0")
def probe_targets(spark, sf):
    pages, s = FX.enriched(spark, sf), _signals(spark, sf)
    d = cms.detect(s)
    return cms.probe_targets(pages, s, d["cms_pages"], d["themes"])


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '1.' || page_id % 50 WHEN 1 THEN '2024.' || page_id WHEN 2 THEN 'a1b2' WHEN 3 THEN '1' ELSE '3.2-rc1' END AS v, page_id % 5 IN (0, 4) AS ok FROM pages""")
def asset_versions(spark, sf):
    v = F.expr("case page_id % 5 when 0 then concat('1.', page_id % 50) when 1 then concat('2024.', page_id) when 2 then 'a1b2' when 3 then '1' else '3.2-rc1' end")
    return FX.pages(spark, sf).select("page_id", v.alias("v")).select("page_id", "v", cms.is_asset_version(F.col("v")).alias("ok"))


TARGETS = """SELECT p AS page_id, unnest(['wp-core', 'wp-plugin:contact-form-7', 'wp-plugin:wordpress-seo', 'wp-plugin:acme-tools', 'wp-theme:acme-child']) AS key FROM e WHERE p % 8 = 0
    UNION ALL SELECT p, 'wp-plugin:wordpress-seo' FROM e WHERE p % 8 = 4 UNION ALL SELECT p, 'npm:jquery' FROM e WHERE p % 8 = 3"""


@query(RULES + TARGETS)
def lookup_targets(spark, sf):
    d = _tech(spark, sf, True)
    return L.lookup_targets(d["tech"], d["plugins"], d["themes"]).select("page_id", "key")


@query(RULES + """SELECT p AS page_id, 'tech' AS kind, 'wordpress' AS item, 'update' AS status, 'Update available (6.9.10)' AS label FROM e WHERE p % 8 = 0
    UNION ALL SELECT p, 'plugin', 'cf7', 'behind', 'Latest is 6.0' FROM e WHERE p % 8 = 0 UNION ALL SELECT p, 'theme', 'acme-child', 'unlisted', 'Not on wordpress.org' FROM e WHERE p % 8 = 0
    UNION ALL SELECT p, 'tech', 'jquery', CASE WHEN p % 7 < 5 THEN 'behind' ELSE 'latest' END, CASE WHEN p % 7 < 5 THEN 'Latest is 3.5.1' ELSE 'Latest' END FROM e WHERE p % 8 = 3""")
def update_status(spark, sf):
    d = _tech(spark, sf, True)
    tech, plugins, themes = L.with_latest(d["tech"], d["plugins"], d["themes"], FX.latest(spark, sf))
    row = lambda df, kind, item: df.where("update is not null").select("page_id", F.lit(kind).alias("kind"), F.col(item).alias("item"), "update.status", TE.update_label(F.col("update")).alias("label"))
    return row(tech, "tech", "tech").unionByName(row(plugins, "plugin", "id")).unionByName(row(themes, "theme", "slug"))


@query(RULES + """SELECT p AS page_id, a.key, a.label FROM (SELECT p, unnest(list_filter([
    CASE WHEN p % 8 = 0 THEN {'key': 'wordpress', 'label': 'WordPress 6.9.4'} END, CASE WHEN p % 8 = 0 THEN {'key': 'woocommerce', 'label': 'WooCommerce 8.' || p % 3} END,
    CASE WHEN p % 8 = 1 THEN {'key': 'nextjs', 'label': 'Next.js'} END, CASE WHEN p % 8 = 2 THEN {'key': 'drupal', 'label': 'Drupal 10'} END, CASE WHEN p % 8 = 4 THEN {'key': 'wordpress', 'label': 'WordPress'} END,
    CASE WHEN p % 8 = 6 THEN {'key': 'ghost', 'label': 'Ghost 5.82'} END, CASE WHEN p % 17 <> 0 AND p % 5 = 1 THEN {'key': 'cloudflare', 'label': 'Cloudflare'} END], lambda x: x IS NOT NULL)) AS a FROM e)""")
def built_with(spark, sf):
    return TE.built_with(_tech(spark, sf)["tech"]).select("page_id", "key", "label")


@query(RULES + f"""SELECT page_id, "group", CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, CASE WHEN tech IN ('wordpress', 'woocommerce', 'drupal', 'ghost') THEN 'platform' WHEN tech IN ('nextjs', 'react', 'jquery') THEN 'framework'
      WHEN tech = 'cloudflare' THEN 'hosting' ELSE 'server' END AS "group" FROM ({TECH_ROWS}) UNION ALL SELECT page_id, 'wordpress' FROM ({PLUGINS}) UNION ALL SELECT p, 'wordpress' FROM e WHERE p % 8 = 0) GROUP BY 1, 2""")
def tech_group_counts(spark, sf):
    d = _tech(spark, sf, True)
    return TE.group_counts(TE.tab_rows(d["tech"], d["themes"], d["plugins"]))


@query(RULES + """SELECT p AS page_id, array_to_string(list_filter([
    CASE p % 8 WHEN 0 THEN 'WordPress 6.9.4' || chr(10) || 'WooCommerce 8.' || p % 3 WHEN 1 THEN 'Next.js' || chr(10) || 'React' WHEN 2 THEN 'Drupal 10' WHEN 3 THEN 'jQuery 3.' || p % 7 || '.1' WHEN 4 THEN 'WordPress' WHEN 6 THEN 'Ghost 5.82' END,
    CASE p % 8 WHEN 0 THEN 'Acme Child 1.4 (theme)' || chr(10) || 'Contact Form 7 5.9' || chr(10) || 'Yoast SEO' || chr(10) || 'acme-tools 2.1' WHEN 4 THEN 'Yoast SEO 22.5' END,
    CASE WHEN p % 17 <> 0 AND p % 5 = 1 THEN 'Cloudflare' END, CASE WHEN p % 17 <> 0 THEN CASE p % 5 WHEN 0 THEN 'nginx 1.25.3' WHEN 2 THEN 'Apache' END END,
    CASE WHEN p % 17 <> 0 AND p % 4 = 0 THEN 'PHP 8.2.1' || chr(10) || 'Express' END], lambda x: x IS NOT NULL), chr(10)) AS tech
    FROM e WHERE p % 8 NOT IN (5, 7) OR (p % 17 <> 0 AND p % 5 IN (0, 1, 2))""")
def tech_list(spark, sf):
    d = _tech(spark, sf, True)
    return export.tech_list(TE.tab_rows(d["tech"], d["themes"], d["plugins"]))


# ---------------------------------------------------------------- versions and answers

_VK = lambda n: f"""({n} % 4) * 1000000 + ({n} % 11) * 1000 + CASE WHEN {n} % 3 = 0 THEN 0 ELSE {n} % 13 END"""
_PRE = lambda n: f"CASE {n} % 7 WHEN 0 THEN 100 + {n} % 10 WHEN 1 THEN 1 ELSE 1000 END"


@query(f"""SELECT page_id, CAST(CASE WHEN ka <> kb THEN sign(ka - kb) ELSE sign(pa - pb) END AS BIGINT) AS cmp FROM (SELECT page_id, {_VK('page_id')} AS ka, {_VK('(page_id * 7 + 3)')} AS kb,
    {_PRE('page_id')} AS pa, {_PRE('(page_id * 7 + 3)')} AS pb FROM pages)""")
def version_order(spark, sf):
    df = FX.version_pairs(spark, sf)
    return longs(df.select("page_id", V.compare_versions(F.col("a"), F.col("b")).alias("cmp")))


@query("""SELECT page_id, (n % 4) || '.' || (n % 11) || CASE WHEN n % 3 = 0 THEN '' ELSE '.' || n % 13 END || CASE n % 7 WHEN 0 THEN '-rc.' || n % 10 WHEN 1 THEN '-beta' ELSE '' END AS cleaned,
    n % 3 <> 0 AS exact, n % 7 < 2 AS prerelease, (n % 4) || '.' || (n % 11) AS branch FROM (SELECT page_id, page_id AS n FROM pages)""")
def version_parts(spark, sf):
    a = F.col("a")
    return FX.version_pairs(spark, sf).select(
        "page_id", V.clean_version(a).alias("cleaned"), V.is_exact(a).alias("exact"), V.is_prerelease(a).alias("prerelease"), V.branch_of(a).alias("branch"))


@query(f"""SELECT page_id, CASE WHEN c < 0 THEN 'behind' WHEN c > 0 AND page_id % 7 < 2 THEN 'prerelease' ELSE 'latest' END AS status FROM (SELECT page_id, CASE WHEN ka <> kb THEN sign(ka - kb) ELSE sign(pa - pb) END AS c FROM
    (SELECT page_id, {_VK('page_id')} AS ka, {_VK('(page_id * 7 + 3)')} AS kb, {_PRE('page_id')} AS pa, {_PRE('(page_id * 7 + 3)')} AS pb FROM pages))""")
def version_status(spark, sf):
    return FX.version_pairs(spark, sf).select("page_id", V.latest_status(F.col("a"), F.col("b"))["status"].alias("status"))


@query("""SELECT page_id, CASE WHEN b = 9 THEN 'latest' WHEN b < 7 THEN 'unsupported' WHEN p >= CASE b WHEN 7 THEN 6 ELSE 5 END THEN 'patched' ELSE 'update' END AS status, CASE WHEN b = 9 THEN 4 + 0 END AS dummy
    FROM (SELECT page_id, 5 + page_id % 5 AS b, page_id % 9 AS p FROM pages)""".replace(", CASE WHEN b = 9 THEN 4 + 0 END AS dummy", ""))
def core_status(spark, sf):
    v = F.expr("concat('6.', 5 + page_id % 5, '.', page_id % 9)")
    offers = F.array(*[F.lit(x) for x in ("6.9.0", "6.8.5", "6.7.6", "nightly")])
    return FX.pages(spark, sf).select("page_id", V.core_status(v, offers)["status"].alias("status"))


@query("""SELECT 'x' AS k, max_by(v, o) AS newest FROM (SELECT (page_id % 7) || '.' || (page_id % 12) || '.' || (page_id % 30) AS v, (page_id % 7) * 10000 + (page_id % 12) * 100 + page_id % 30 AS o FROM pages)""")
def newest_version(spark, sf):
    v = F.expr("concat(page_id % 7, '.', page_id % 12, '.', page_id % 30)")
    return FX.pages(spark, sf).select(v.alias("v")).agg(F.lit("x").alias("k"), F.max_by("v", V.version_key(F.col("v"))).alias("newest"))


ANSWERS = """SELECT page_id AS p, 'k' || page_id AS key, CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 3 <> 0 AND page_id % 11 <> 0 THEN '1.' || page_id END AS version,
    CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 3 = 0 THEN '7.1.3|6.9.10' END AS offers,
    page_id % 5 = 0 OR (page_id % 7 <> 0 AND page_id % 3 <> 0 AND page_id % 11 = 0) AS unlisted,
    CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 3 = 2 AND page_id % 11 <> 0 THEN 'Theme ' || page_id END AS theme_name,
    CASE WHEN page_id % 5 <> 0 AND page_id % 7 = 0 THEN 'Not JSON' END AS error,
    strftime(TIMESTAMP '2026-01-02 00:00:00' - to_hours(page_id % 24), '%Y-%m-%d %H:%M:%S') AS fetched_at FROM pages"""


@query(f"SELECT key, version, offers, unlisted, theme_name, error FROM ({ANSWERS})")
def latest_answers(spark, sf):
    a = L.read_answers(FX.raw_answers(spark, sf))
    return a.select("key", "version", joined("offers"), "unlisted", "theme_name", "error")


def _cache_split(spark, sf):
    answers = L.read_answers(FX.raw_answers(spark, sf))
    return L.split_cache(answers.select("key", "kind", "name"), answers, F.lit("2026-01-02 00:00:00").cast("timestamp"))


@query(f"SELECT key FROM ({ANSWERS}) WHERE error IS NULL AND p % 24 < 12")
def cached_answers(spark, sf):
    return _cache_split(spark, sf)[0].select("key")


@query(f"SELECT key FROM ({ANSWERS}) WHERE NOT (error IS NULL AND p % 24 < 12)")
def answers_to_fetch(spark, sf):
    return _cache_split(spark, sf)[1].select("key")


# ---------------------------------------------------------------- structured data and questions


@query(RULES + """SELECT p AS page_id, CAST(0 AS BIGINT) AS idx, p % 4 <> 2 AS ok, CASE WHEN p % 4 = 2 THEN '{"@type":"Bad",}' END AS error_text FROM e WHERE p % 4 < 3""")
def jsonld_blocks(spark, sf):
    return longs(SD.jsonld_blocks(X.page_records(FX.enriched(spark, sf), "jsonld")).select("page_id", "idx", "ok", "error_text"))


@query(RULES + "SELECT p AS page_id, unnest(CASE p % 4 WHEN 0 THEN ['Article', 'Person', 'Author'] ELSE ['Product', 'Offer'] END) AS type FROM e WHERE p % 4 < 2")
def schema_types(spark, sf):
    return SD.schema_types(SD.jsonld_blocks(X.page_records(FX.enriched(spark, sf), "jsonld"))).select("page_id", "type")


@query(RULES + f"""SELECT p AS page_id, parent, prop, type, value FROM (SELECT p, unnest([
    {{'parent': NULL, 'prop': NULL, 'type': 'https://schema.org/Product', 'value': NULL}}, {{'parent': 0, 'prop': 'name', 'type': NULL, 'value': 'P ' || p}},
    {{'parent': 0, 'prop': 'offers', 'type': 'https://schema.org/Offer', 'value': NULL}}, {{'parent': 1, 'prop': 'price', 'type': NULL, 'value': p || '.50'}},
    {{'parent': 1, 'prop': 'url', 'type': NULL, 'value': {SITE} || '/o/' || p}}, {{'parent': 0, 'prop': 'tag', 'type': NULL, 'value': 'a'}}, {{'parent': 0, 'prop': 'tag', 'type': NULL, 'value': 'b'}}]) AS a FROM e)
    """.replace("parent, prop, type, value FROM", "CAST(a.parent AS BIGINT) AS parent, a.prop, a.type, a.value FROM"))
def microdata_rows(spark, sf):
    return longs(SD.microdata(FX.microdata_pages(spark, sf)).select("page_id", "parent", "prop", "type", "value"))


@query(RULES + f"""SELECT p AS page_id, '{{"@type":"Product","@id":"urn:' || p || '","name":"P ' || p || '","offers":{{"@type":"Offer","price":"' || p || '.50","url":"' || {SITE} || '/o/' || p || '"}},"tag":["a","b"]}}' AS json FROM e""")
def microdata_objects(spark, sf):
    return SD.microdata_objects(SD.microdata(FX.microdata_pages(spark, sf))).select("page_id", "json")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Product, Offer' WHEN 1 THEN 'Untyped item' ELSE 'https://other.org/T' END AS name FROM pages")
def microdata_type_names(spark, sf):
    t = F.expr("case page_id % 3 when 0 then 'https://schema.org/Product HTTP://schema.org/Offer' when 1 then '' else 'https://other.org/T' end")
    return FX.pages(spark, sf).select("page_id", SD.microdata_type_name(t).alias("name"))


@query(RULES + "SELECT p AS page_id, CAST(CASE p % 4 WHEN 0 THEN 3 ELSE 2 END AS BIGINT) AS schema_items, CASE p % 4 WHEN 0 THEN 'Article|Author|Person' ELSE 'Offer|Product' END AS types FROM e WHERE p % 4 < 2")
def schema_summary(spark, sf):
    pages = FX.enriched(spark, sf)
    blocks = SD.jsonld_blocks(X.page_records(pages, "jsonld"))
    s = SD.schema_summary(blocks, SD.microdata(pages))
    return longs(s.select("page_id", "schema_items", joined("types")))


@query("SELECT page_id, page_id % 4 < 3 AND page_id % 5 <> 0 AS serp FROM pages")
def result_pages(spark, sf):
    return FX.serp_pages(spark, sf).select("page_id", U.is_serp(F.col("url")).alias("serp"))


@query("""SELECT page_id, CAST(a.i AS BIGINT) AS idx, a.q AS question, a.a AS answer, a.s AS source, a.t AS source_title FROM (SELECT page_id, unnest([
    {'i': 0, 'q': 'What is page ' || page_id || '?', 'a': '', 's': '', 't': ''},
    {'i': 1, 'q': 'Why ' || page_id || '?', 'a': 'Because of ' || page_id || '. g', 's': 'https://src.example.org/' || page_id, 't': 'Source ' || page_id},
    {'i': 2, 'q': 'How ' || page_id || '?', 'a': '', 's': '', 't': ''}, {'i': 3, 'q': 'Who ' || page_id || '?', 'a': '', 's': '', 't': ''}]) AS a
    FROM pages WHERE page_id % 4 < 3 AND page_id % 5 <> 0)""")
def people_also_ask(spark, sf):
    return longs(serp.people_also_ask(FX.serp_pages(spark, sf)))


@query(RULES + "SELECT p AS page_id, CAST(0 AS BIGINT) AS idx, 'schema:Article p' || p AS value FROM e")
def rdfa_types(spark, sf):
    df = FX.enriched(spark, sf).withColumn("html", F.expr("replace(html, '<article>', concat('<article typeof=\"schema:Article  p', page_id, '\">'))"))
    return longs(X.children(X.page_records(df, "rdfa_types"), "rdfa_types"))


# ---------------------------------------------------------------- exports

GUARD = lambda x: f"""(CASE WHEN regexp_matches({x}, '^[=+\\-@\\t\\r]') THEN '''' || {x} ELSE {x} END)"""
CSV = lambda x: f"""CASE WHEN regexp_matches({GUARD(x)}, '[",\\r\\n]') THEN '"' || replace({GUARD(x)}, '"', '""') || '"' ELSE {GUARD(x)} END"""


@query(f"""SELECT doc_id, {CSV('t')} || ',' || {CSV('lang')} AS csv_line FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN '"' ELSE '' END || text AS t FROM documents)""")
def csv_lines(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("t", F.expr("concat(case doc_id % 4 when 0 then '=' when 1 then '@' when 2 then '\"' else '' end, text)"))
    return export.csv_lines(df, {"t": "Text", "lang": "Lang"}, "doc_id")


@query(RULES + f"SELECT page_id, idx, href, text, text_source, kind, rel, target, 'yes' AS visible FROM ({ADDED_LINKS} UNION ALL {NAV_LINKS})")
def links_export(spark, sf):
    return longs(export.links_export(_links(spark, sf)).drop("raw"))


@query(RULES + f"""SELECT page_id, idx, src, coalesce(alt, '') AS alt_text, CASE WHEN missing_alt THEN 'missing' WHEN empty_alt THEN 'empty' ELSE 'present' END AS alt_status, title,
    CASE WHEN width IS NULL THEN '' ELSE width || 'x300' END AS "natural", CASE WHEN width IS NULL THEN '' ELSE '300x150' END AS displayed, loading, CASE WHEN coalesce(shown, true) THEN 'yes' ELSE 'no' END AS visible FROM ({FLAGS})""")
def images_export(spark, sf):
    return longs(export.images_export(_images(spark, sf)).drop("raw"))


@query("""SELECT page_id, CAST(a.i AS BIGINT) AS idx, a.q AS question, a.a AS answer, a.t AS source_title, a.s AS source FROM (SELECT page_id, unnest([
    {'i': 0, 'q': 'What is page ' || page_id || '?', 'a': '', 's': '', 't': ''},
    {'i': 1, 'q': 'Why ' || page_id || '?', 'a': 'Because of ' || page_id || '. g', 's': 'https://src.example.org/' || page_id, 't': 'Source ' || page_id},
    {'i': 2, 'q': 'How ' || page_id || '?', 'a': '', 's': '', 't': ''}, {'i': 3, 'q': 'Who ' || page_id || '?', 'a': '', 's': '', 't': ''}]) AS a
    FROM pages WHERE page_id % 4 < 3 AND page_id % 5 <> 0)""")
def questions_export(spark, sf):
    return longs(export.questions_export(serp.people_also_ask(FX.serp_pages(spark, sf))))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') || '-links-2026-03-04.csv', '[^A-Za-z0-9.\\-_]', '_', 'g') AS name FROM pages")
def export_names(spark, sf):
    return FX.pages(spark, sf).select("page_id", export.export_name("links", F.col("url"), F.lit("2026-03-04").cast("date")).alias("name"))


@query(RULES + f"""SELECT p AS page_id, CASE p % 3 WHEN 0 THEN 'H1  Extra <one>' WHEN 1 THEN '  H2  A bolder' || chr(10) || '      H4  B' ELSE '  H2  ' END || chr(10) || 'H1  ' || {CLEAN(DEC('''regexp_extract(html, '<h1>([^<]*)</h1>', 1)'''))} AS outline FROM e""")
def outlines(spark, sf):
    return export.outline(X.page_records(FX.enriched(spark, sf), "headings"))


@query(f"SELECT page_id, array_to_string(list_transform({NAV}, lambda x: {ORIGIN} || {ENC('x')}), chr(10)) AS urls FROM pages")
def url_lists(spark, sf):
    return export.url_list(X.page_records(_raw(spark, sf), "links"))


# ---------------------------------------------------------------- the audit and increments


@query(RULES + f""", v AS ({VERDICT}) SELECT p AS page_id, {TITLE} AS title, {STATUS(TITLE, 30, 60)} AS title_status, CASE p % 4 WHEN 2 THEN 'good' WHEN 3 THEN 'long' ELSE 'missing' END AS description_status,
    CASE p % 5 WHEN 0 THEN 'self' WHEN 1 THEN 'other' WHEN 2 THEN 'missing' WHEN 3 THEN 'conflict' ELSE 'empty' END AS canonical_status, CAST(CASE p % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS h1,
    CAST(1 AS BIGINT) AS heading_issues, CAST(8 + len({NAV}) AS BIGINT) AS links, CAST(2 AS BIGINT) AS images, CAST(CASE WHEN p % 4 < 3 THEN 1 ELSE 0 END AS BIGINT) AS jsonld_blocks, reasons = '' AS indexable, reasons
    FROM e JOIN v ON v.page_id = e.p""")
def page_audit(spark, sf):
    a = audit.page_audit(FX.enriched(spark, sf), FX.responses(spark, sf), FX.robots_files(spark, sf))
    return longs(a.select("page_id", "title", "title_status", "description_status", "canonical_status", "h1", "heading_issues", F.col("link_stats.total").alias("links"),
                          F.col("image_stats.total").alias("images"), "jsonld_blocks", "indexable", joined("reasons")))


def _scratch(spark) -> str:
    """A new folder in the cluster's shared checkpoint folder, or a local one in tests."""
    return f"{skew.shared_folder(spark)}/audit-{uuid.uuid4().hex}"


@query("SELECT max(page_id) AS page_id, page_id % 40 AS slot FROM pages GROUP BY 2")
def latest_snapshots(spark, sf):
    df = FX.pages(spark, sf).select("page_id", F.expr("cast(page_id % 40 as string)").alias("url"), F.expr("timestamp_seconds(page_id)").alias("collected_at"))
    return tables.latest_snapshot(df).select("page_id", F.col("url").cast("bigint").alias("slot"))


@query(f"SELECT page_id, url, {TITLE} AS title, CAST(len({NAV}) AS BIGINT) AS links FROM pages")
def incremental_audit(spark, sf):
    folder = _scratch(spark)
    stream = INC.page_stream(spark, f"{sf}/pages.parque[t]").withColumn("collected_at", F.expr("timestamp_seconds(1700000000 + page_id)"))
    schema = "page_id bigint, url string, collected_at timestamp, title string, links int"
    log = INC.BatchLog(spark, f"{folder}/audit", schema, key="page_id")  # two pages of the table may have one address
    work = lambda pages: X.page_records(pages, "head", "links").select("page_id", "url", "collected_at", F.col("head.title").alias("title"), F.col("links_total").alias("links"))
    INC.run_incremental(stream, work, log, f"{folder}/checkpoint").awaitTermination()
    return longs(log.read().select("page_id", "url", "title", "links"))


@query(f"SELECT key, version, fetched_at FROM ({ANSWERS}) WHERE error IS NULL")
def refreshed_cache(spark, sf):
    answers = L.read_answers(FX.raw_answers(spark, sf))
    cut = F.expr("timestamp'2026-01-01 12:00:00'")
    first = INC.refresh_cache(answers.limit(0), answers.where(F.col("fetched_at") <= cut))
    return INC.refresh_cache(first, answers).select("key", "version", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


@query(f"""SELECT key, version, CASE WHEN fetched_at > '2026-01-01 12:00:00' THEN 'kept' ELSE 'expired' END AS event FROM (SELECT 'k' || p % 60 AS key, version, fetched_at,
    row_number() OVER (PARTITION BY p % 60 ORDER BY fetched_at DESC, coalesce(version, '') DESC) AS n FROM ({ANSWERS}) WHERE error IS NULL) WHERE n = 1""")
def cache_stream(spark, sf):
    """Three batches of answers in the order of their times; the stream stops after two and goes on from its checkpoint."""
    folder = _scratch(spark)
    answers = L.read_answers(FX.raw_answers(spark, sf)).withColumn("key", F.concat(F.lit("k"), F.regexp_replace("key", "k", "").cast("bigint") % 60))
    hour = F.hour("fetched_at") + 24 * (F.dayofmonth("fetched_at") - 1)
    batches = [answers.where(hour.between(a, b)) for a, b in ((0, 8), (9, 16), (17, 24))]
    schema = answers.schema
    log = INC.BatchLog(spark, f"{folder}/events", INC.CACHE_EVENTS, "key", "fetched_at")

    def go_on():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/answers")
        query = INC.cached_answers(stream).writeStream.foreachBatch(log.append).option("checkpointLocation", f"{folder}/checkpoint")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/answers")
        if n:
            go_on()
    events = log.all_rows()
    last = events.groupBy("key").agg(F.max_by(F.struct("event", "version"), F.struct("fetched_at", F.when(F.col("event") == "expired", 1).otherwise(0), "version")).alias("e"))
    return last.select("key", "e.version", "e.event")


UPDATES = """SELECT p AS page_id, 'tech' AS kind, 'wordpress' AS item, NULL AS id, 'update' AS status FROM e WHERE p % 8 = 0 UNION ALL SELECT p, 'plugin', 'cf7', NULL, 'behind' FROM e WHERE p % 8 = 0
    UNION ALL SELECT p, 'theme', 'acme-child', NULL, 'unlisted' FROM e WHERE p % 8 = 0 UNION ALL SELECT p, 'tech', 'jquery', NULL, CASE WHEN p % 7 < 5 THEN 'behind' ELSE 'latest' END FROM e WHERE p % 8 = 3"""


def _refinery(spark, sf, folder: str):
    """Trackers and update status of pages, refined by containers and by latest versions."""
    requests, runtime, probes = FX.page_requests(spark, sf), FX.runtime_state(spark, sf), FX.probes(spark, sf)
    responses = FX.responses(spark, sf)
    none = F.lit(None).cast("string")

    def derive(pages, signals, sides):
        own = lambda df: df.join(pages.select("page_id"), "page_id", "left_semi")
        asked = own(requests)
        trackers = TR.detect_trackers(signals, asked, own(runtime), sides["containers"])
        d = cms.detect(signals, headers=TE.page_headers(pages, responses), probes=cms.accepted_probes(probes, pages))
        tech, plugins, themes = L.with_latest(d["tech"], d["plugins"], d["themes"], sides["latest"])
        row = lambda df, kind, item: df.where("update is not null").select("page_id", F.struct(F.lit(kind).alias("kind"), F.col(item).alias("item"), none.alias("id"), F.col("update.status").alias("status")).alias("row"))
        rows = trackers.select("page_id", F.struct(F.lit("tracker").alias("kind"), F.col("tracker").alias("item"), "id", "status").alias("row"))
        rows = rows.unionByName(row(tech, "tech", "tech")).unionByName(row(plugins, "plugin", "id")).unionByName(row(themes, "theme", "slug"))
        key = lambda df, source, column: df.select("page_id", F.struct(F.lit(source).alias("source"), F.col(column).alias("key")).alias("named"))
        keys = key(TR.named_containers(signals, asked), "containers", "container_id").unionByName(key(L.lookup_targets(d["tech"], d["plugins"], d["themes"]), "latest", "key"))
        both = rows.select("page_id", "row", F.lit(None).cast("struct<source:string,key:string>").alias("named")).unionByName(keys.select("page_id", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "named"))
        return both.groupBy("page_id").agg(F.array_sort(F.collect_list("row")).alias("result"), F.array_sort(F.collect_list("named")).alias("keys"))

    sides = {name: RF.Side(tables.SCHEMAS[name], key) for name, key in (("containers", "container_id"), ("latest", "key"))}
    facts = "page_id bigint, kind string, seq int, key string, value string"
    return RF.Refinery(spark, folder, sides, facts, "array<struct<kind:string,item:string,id:string,status:string>>", lambda pages: X.signals(X.page_records(pages, *X.SIGNAL_COLUMNS)), derive)


@query(RULES + f"SELECT page_id, 'tracker' AS kind, tracker AS item, id, status FROM ({FULL_TRACKERS}) UNION ALL {UPDATES}")
def refined_audit(spark, sf):
    """Pages, then containers, then answers, each a batch of its own stream; later batches derive the pages they touch."""
    folder = _scratch(spark)
    refinery = _refinery(spark, sf, f"{folder}/state")
    at = lambda n: F.expr(f"timestamp_seconds({n})").alias("fetched_at")
    arrivals = {
        "pages": FX.enriched(spark, sf).select("page_id", "url", "html", F.expr("timestamp_seconds(1700000000 + page_id)").alias("collected_at")),
        "containers": FX.containers(spark, sf).select("*", at(1)), "latest": FX.latest(spark, sf),
    }
    for source, rows in arrivals.items():
        rows.write.parquet(f"{folder}/{source}")
        refinery.start(source, spark.readStream.schema(rows.schema).parquet(f"{folder}/{source}")).awaitTermination()
    return refinery.read().select("page_id", F.explode("result").alias("r")).select("page_id", "r.*")


@query(RULES + "SELECT p AS page_id, 'acme' AS tracker, 'AC-' || (1030000 + p) AS id FROM e")
def custom_catalog(spark, sf):
    own = [dict(id="acme", name="Acme", group="ads", format=r"AC-\d{4,9}", code=[("acme(", r"acme\('(AC-\d{4,9})'", "acme call")])]
    tracker_catalog.validate(own)
    df = FX.enriched(spark, sf).withColumn("html", F.expr("replace(html, '</head>', concat('<script>acme(\\'AC-', 1030000 + page_id, '\\')</script></head>'))"))
    s = X.staged_signals(df)
    return TR.detect_trackers(s, catalog=own).select("page_id", "tracker", "id")


# ---------------------------------------------------------------- cases that the enriched pages do not hold


@query("""SELECT 'GTM-T' || lpad('' || page_id, 6, '0') AS container_id, 'meta' AS tracker, CAST(NULL AS VARCHAR) AS id, 'Meta Pixel template' AS label, true AS variable FROM pages WHERE page_id % 4 = 0""")
def container_templates(spark, sf):
    """Custom templates with a variable id: allowed to load Meta's script, another host's, or none; or allowed in another template's block."""
    allowed = """case page_id % 4 when 0 then '"permissions":[{"inject_script":{"urls":["https:\\\\/\\\\/connect.facebook.net\\\\/*"]}}]'
        when 1 then '"permissions":[{"inject_script":{"urls":["https:\\\\/\\\\/cdn.example.net\\\\/*"]}}]' else '"permissions":[{"send_pixel":{"urls":["https:\\\\/\\\\/connect.facebook.net\\\\/*"]}}]' end"""
    other = """if(page_id % 4 = 3, concat('\n"__cvt_9_', page_id, '":{"permissions":[{"inject_script":{"urls":["https://connect.facebook.net/*"]}}]}'), '')"""
    text = f"""concat('var data = {{"resource":{{"macros":[{{"function":"__v"}}],"tags":[{{"function":"__cvt_1_', page_id, '","vtp_pixelId":["macro",0]}}]}}}};\n"__cvt_1_', page_id, '":{{', {allowed}, '}}', {other})"""
    cid = F.expr("concat('GTM-T', lpad(page_id, 6, '0'))")
    rows = FX.pages(spark, sf).select(cid.alias("container_id"), F.concat(F.lit("https://www.googletagmanager.com/gtm.js?id="), cid).alias("url"), F.expr(text).alias("text"))
    return K.scan_containers(K.read_containers(rows))


def _own_pages(spark, sf, head: str, body: str = "'<body>'"):
    df = FX.pages(spark, sf).select("page_id", F.expr("concat('https://shop', page_id, '.example.com/')").alias("url"))
    return df.withColumn("html", F.expr(f"concat('<html><head>', {head}, '</head>', {body}, '<p>Text</p></body></html>')"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Theme Dawn 15.' || page_id WHEN 1 THEN 'Theme Craft' WHEN 2 THEN 'Theme Live 2.' || page_id END AS detail FROM pages""")
def storefront_themes(spark, sf):
    """Theme values in code, without a version, in the runtime, and missing."""
    head = """case page_id % 4 when 0 then concat('<script>var Shopify = {}; Shopify.theme = {"name":"x","schema_name":"Dawn","schema_version":"15.', page_id, '"};</script>')
        when 1 then '<script>Shopify.theme = {"schema_name":"Craft","schema_version":null};</script>' else '<script>Shopify.theme = {"name":"own"};</script>' end"""
    live = "array(struct('shopify.theme.schema_name' as key, 'Live' as value), struct('shopify.theme.schema_version' as key, concat('2.', page_id) as value))"
    runtime = FX.pages(spark, sf).where("page_id % 4 = 2").select("page_id", F.lit("tech").alias("space"), F.explode(F.expr(live)).alias("r")).select("page_id", "space", "r.*")
    d = cms.detect(X.staged_signals(_own_pages(spark, sf, head)), runtime=runtime)
    return d["tech"].where("tech = 'shopify'").select("page_id", "detail")


@query("""SELECT page_id, a.kind, a.slug, a.ver FROM pages, unnest([{'kind': 'themes', 'slug': 'acme', 'ver': '1.' || page_id}, {'kind': 'plugins', 'slug': 'acme-tools', 'ver': '2.1'}]) AS t(a) WHERE page_id % 2 = 0""")
def content_folders(spark, sf):
    """A renamed content folder counts where the body class names a theme that lies in it."""
    head = """concat('<link rel="stylesheet" href="/app/themes/acme/style.css?ver=1.', page_id, '"><script src="/app/plugins/acme-tools/a.js?ver=2.1"></script><script src="/other/plugins/no/a.js?ver=3.1"></script>')"""
    body = """concat('<body class="home ', if(page_id % 2 = 0, 'wp-theme-acme', 'wp-theme-else'), '">')"""
    signals = X.staged_signals(_own_pages(spark, sf, head, body))
    return cms.asset_paths(signals, TE.page_urls(signals)).select("page_id", "kind", "slug", "ver")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '6.' || page_id % 5 WHEN page_id % 3 = 1 THEN '6.1' END AS version, CASE WHEN page_id % 3 = 0 THEN 'likely' WHEN page_id % 3 = 1 THEN 'confirmed' END AS confidence FROM pages""")
def stamped_core_versions(spark, sf):
    """A theme's asset stamped with another version than its own says the core's, where nothing states it."""
    head = """concat(if(page_id % 3 = 1, '<meta name="generator" content="WordPress 6.1">', ''), '<script src="/wp-content/themes/acme/app.js?ver=', if(page_id % 3 = 2, '1.4', concat('6.', page_id % 5)), '"></script>')"""
    theme = "concat('https://shop', page_id, '.example.com/wp-content/themes/acme/style.css')"
    probes = FX.pages(spark, sf).select("page_id", F.lit("theme").alias("kind"), F.lit("acme").alias("slug"), F.expr(theme).alias("url"),
                                        F.lit("/*\nTheme Name: Acme\nVersion: 1.4\n*/").alias("text"), F.lit(False).alias("capped"), F.lit(None).cast("string").alias("error"))
    pages = _own_pages(spark, sf, head)
    d = cms.detect(X.staged_signals(pages), probes=cms.accepted_probes(probes, pages))
    return d["tech"].where("tech = 'wordpress'").select("page_id", "version", "confidence")


@query("""SELECT page_id, a.tech, a.version, a.implied FROM pages, unnest(list_filter([{'tech': 'acmejs', 'version': '3.' || page_id, 'implied': false}, {'tech': 'acmecore', 'version': NULL, 'implied': true},
    CASE WHEN page_id % 2 = 0 THEN {'tech': 'acmehost', 'version': '7', 'implied': false} END], lambda x: x IS NOT NULL)) AS t(a)""")
def custom_technologies(spark, sf):
    own = [
        dict(id="acmejs", name="Acme JS", group="framework", implies=("acmecore",), npm=None, wp=(), wporg=None, ns=(), sources={"inline": [("acmejs(", r"acmejs\('(\d+\.\d+)'", "acmejs call")]}),
        dict(id="acmecore", name="Acme Core", group="framework", implies=(), npm=None, wp=(), wporg=None, ns=(), sources={}),
        dict(id="acmehost", name="Acme Host", group="hosting", implies=(), npm=None, wp=(), wporg=None, ns=(), sources={"header": [("x-acme", r"^acme/(\d+)")]}),
    ]
    tech_catalog.validate(own)
    signals = X.staged_signals(_own_pages(spark, sf, """concat('<script>acmejs(\\'3.', page_id, '\\')</script>')"""))
    headers = FX.pages(spark, sf).where("page_id % 2 = 0").select("page_id", F.lit("x-acme").alias("header"), F.lit("other, Acme/7").alias("value"))
    return cms.detect(signals, headers=headers, catalog=own)["tech"].select("page_id", "tech", "version", "implied")


@query("""SELECT page_id, a.i AS idx, a.href, CASE WHEN (page_id % 2 = 0) = (a.i < 2) AND a.i < 3 THEN 'internal' ELSE 'external' END AS kind FROM pages, unnest([{'i': 0, 'href': 'https://xn--bcher-kva.example/a'},
    {'i': 1, 'href': 'https://www.xn--bcher-kva.example/b'}, {'i': 2, 'href': 'https://xn--e1afmkfd.xn--p1ai/c'}, {'i': 3, 'href': 'https://xn--r8jz45g.xn--zckzah/d'}]) AS t(a)""")
def international_hosts(spark, sf):
    """Hosts in their own letters and in ASCII form are one; backslashes are slashes."""
    df = _own_pages(spark, sf, "''").withColumn("url", F.expr("if(page_id % 2 = 0, concat('https://B\u00fccher.Example/', page_id), concat('https://\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444/', page_id))"))
    links = "<a href='https://xn--bcher-kva.example/a'>A</a><a href='https://www.b\u00fccher.example/b'>B</a><a href='https:\\\\\u041f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444\\c'>C</a><a href='https://\u4f8b\u3048\u3002\u30c6\u30b9\u30c8/d'>D</a>"
    df = df.withColumn("html", F.lit(f"<html><body>{links}</body></html>"))
    return longs(X.children(A.classify_links(X.page_records(df, "links")), "links").select("page_id", "idx", "href", "kind"))


_REFERENCES = {"© 2026": "&copy 2026", "¬it; x": "&notit; x", "∉": "&notin;", "≂̸ fj ≠": "&NotEqualTilde; &fjlig; &ne;", "“–”": "&#147;&#150;&#148;", "&nosuch; & &;": "&nosuch; & &;", "<&amp": "&lt&amp;amp", "é€𝔄": "&eacute&euro;&Afr;"}


@query(f"""SELECT page_id, trim(t.title || ' ' || page_id) AS title, 'https://shop' || page_id || '.example.com/?a=1&copy=2&amp=3&lt' || page_id || '&' || page_id AS href FROM pages,
    (VALUES {', '.join(f"({i}, '{text}')" for i, text in enumerate(_REFERENCES))}) t(n, title) WHERE t.n = page_id % {len(_REFERENCES)}""")
def named_references(spark, sf):
    """References without a semicolon, of two code points, of old code pages, and those that attributes leave alone."""
    titles = F.expr("element_at(array(" + ", ".join(f"'{t}'" for t in _REFERENCES.values()) + f"), cast(page_id % {len(_REFERENCES)} + 1 as int))")
    df = _own_pages(spark, sf, "''").withColumn("t", titles)
    df = df.withColumn("html", F.concat(F.lit("<title>"), "t", F.lit(" "), "page_id", F.lit('</title><body><a href="/?a=1&copy=2&amp=3&lt'), "page_id", F.lit("&amp;"), "page_id", F.lit('">x</a></body>')))
    r = X.page_records(df, "head", "links")
    return r.select("page_id", F.col("head.title").alias("title"), F.get("links", F.lit(0))["href"].alias("href"))


# ---------------------------------------------------------------- the element tree


@query("""SELECT page_id, s.selector, s.href FROM pages, unnest([{'selector': '.menu a', 'href': '/n/x' || page_id}, {'selector': '.menu a', 'href': '/n/y'}, {'selector': 'li > a', 'href': '/n/x' || page_id},
    {'selector': 'li > a', 'href': '/n/y'}, {'selector': 'ul ul a', 'href': '/n/y'}, {'selector': 'p a', 'href': '/n/z'}, {'selector': 'div div a', 'href': '/n/w'}, {'selector': '.a a', 'href': '/n/x' || page_id},
    {'selector': '.a a', 'href': '/n/y'}, {'selector': '.a a', 'href': '/n/z'}, {'selector': '.a a', 'href': '/n/w'}, {'selector': 'span > a', 'href': '/n/out'}]) AS t(s)""")
def descendant_selectors(spark, sf):
    # Pages are dealt once; their tags stay where they are through every window.
    rows = EL.elements(EL.markup(FX.nested_pages(spark, sf).repartition("page_id")))
    named, classed = (lambda n: F.col("name") == n), (lambda c: H.attr(F.col("tag"), "class") == c)
    rows = rows.withColumn("href", F.when(named("a"), H.attr(F.col("tag"), "href")))
    conditions = {"a": F.col("href").rlike("^/n/"), ".menu": classed("menu"), ".a": classed("a"), **{n: named(n) for n in ("p", "ul", "div", "li", "span")}}
    paths = {".menu a": (".menu", " ", "a"), "p a": ("p", " ", "a"), ".a a": (".a", " ", "a"), "ul ul a": ("ul", " ", "ul", " ", "a"),
             "div div a": ("div", " ", "div", " ", "a"), "li > a": ("li", ">", "a"), "span > a": ("span", ">", "a")}
    return EL.select_paths(rows, conditions, paths).select("page_id", "selector", "href")


@query("""SELECT page_id, e.name, e.text FROM pages, unnest([{'name': 'ul', 'text': 'OneXYThree'}, {'name': 'p', 'text': 'TextZ'}, {'name': 'span', 'text': 'Out'}]) AS t(e)""")
def element_texts(spark, sf):
    tokens = skew.staged(EL.markup(FX.nested_pages(spark, sf).repartition(FX.splits(spark), "page_id")))
    rows = skew.staged(EL.elements(tokens))
    first = rows.where("name in ('ul', 'p', 'span')").groupBy("page_id", "name").agg(F.min_by(F.struct("start", "end"), "start").alias("e")).select("page_id", "name", "e.*")
    texts = EL.texts_within(first, tokens)
    return first.join(texts, ["page_id", "start"]).select("page_id", "name", "text")


# ---------------------------------------------------------------- every catalog entry, and its look-alike


@query(f"SELECT page_id, entry AS tracker, value AS id FROM pages JOIN (VALUES {SA.sql_rows(SA.TRACKERS)}) s(slot, entry, value) ON page_id % {2 * len(SA.TRACKERS)} = slot")
def tracker_samples(spark, sf):
    pages, requests = SA.tracker_pages(spark, _raw(spark, sf))
    return TR.detect_trackers(X.staged_signals(pages), requests).select("page_id", "tracker", "id")


@query(f"""SELECT page_id, entry AS tech, value AS version FROM pages JOIN (VALUES {SA.sql_rows(SA.TECHNOLOGIES)}) s(slot, entry, value) ON page_id % {2 * len(SA.TECHNOLOGIES)} = slot
    UNION ALL SELECT page_id, 'wordpress', NULL FROM pages WHERE page_id % {2 * len(SA.TECHNOLOGIES)} IN ({', '.join(str(i) for i, t in enumerate(SA.TECHNOLOGIES) if t[2].startswith('/wp-content/'))})""")
def technology_samples(spark, sf):
    pages, headers, runtime = SA.technology_pages(spark, _raw(spark, sf))
    found = cms.detect(X.staged_signals(pages), headers=headers, runtime=runtime)
    # Entries that a sample merely implies are left to the query of implied rows.
    tech = found["tech"].where("not implied").select("page_id", "tech", "version")
    return tech.unionByName(found["plugins"].where("named").select("page_id", F.col("id").alias("tech"), "version"))


# ---------------------------------------------------------------- files


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '''=' || url ELSE url END AS address, CAST(page_id % 4 AS BIGINT) AS slot FROM pages")
def csv_folders(spark, sf):
    df = _raw(spark, sf).select("page_id", F.expr("if(page_id % 3 = 0, concat('=', url), url)").alias("address"), F.expr("page_id % 4").alias("slot"))
    folder = f"{_scratch(spark)}/csv"
    export.write_csv(df, folder, {"page_id": "Page", "address": "Address"}, ["slot"])
    got = spark.read.option("header", True).option("escape", '"').csv(folder)
    return got.select(F.col("Page").cast("bigint").alias("page_id"), F.col("Address").alias("address"), F.col("slot").cast("bigint").alias("slot"))


@query("""SELECT 'Page,"The, address"' AS line UNION ALL SELECT page_id || ',' || CASE WHEN page_id % 3 = 0 THEN '"a,' || url || '"' ELSE '''+' || url END FROM pages""")
def csv_bytes(spark, sf):
    df = _raw(spark, sf).select("page_id", F.expr("if(page_id % 3 = 0, concat('a,', url), concat('+', url))").alias("address"))
    folder = f"{_scratch(spark)}/exact"
    export.write_exact_csv(df, folder, {"page_id": "Page", "address": "The, address"}, ["page_id"])
    # The reader takes the byte-order mark off the first line.
    return spark.read.text(folder).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("line"))
