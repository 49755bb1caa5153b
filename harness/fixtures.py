"""Test inputs derived from the given tables by rules on ``page_id``.

The given pages carry no metas, canonicals, alternates, images or trackers. These
expressions add them, so each operator has something to find, and the check SQL can
state the expected answer from the same rules without reading markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


HEAD = """concat(
  case page_id % 4 when 1 then '<meta name="description" content="">'
    when 2 then concat('<meta name=" Description" content="', repeat('ab ', 26), 'zz"><meta name="description" content="second">')
    when 3 then concat("<META NAME=description CONTENT='", repeat('cd ', 66), "yy'>") else '' end,
  case page_id % 6 when 0 then '<meta name="robots" content="noindex">' when 1 then '<meta name="robots" content="NoFollow">'
    when 2 then '<meta name="robots" content="none">' when 3 then '<meta name="robots" content="max-snippet: 50, noindex">' else '' end,
  case when page_id % 13 = 0 then '<meta name="googlebot" content="bingbot: noindex, googlebot: nofollow">' else '' end,
  case page_id % 5 when 0 then concat('<link rel="canonical" href="', url, '#frag">')
    when 1 then '<link href="https://canonical.example.org/x" rel="Canonical">'
    when 3 then concat('<link rel="canonical" href="', url, '"><link rel="canonical" href="/other">')
    when 4 then '<link rel="canonical">' else '' end,
  case when page_id % 11 = 0 then '<meta http-equiv="Refresh" content="5; url=/next">' else '' end,
  case when page_id % 3 <> 0 then '<meta name="viewport" content="width=device-width">' else '' end,
  case when page_id % 4 < 2 then concat(
    '<link rel="alternate" hreflang="en" href="', url, '">',
    case when page_id % 7 = 0 then '' else concat('<link rel="alternate" hreflang="fr" href="',
      case when page_id % 10 = 0 then concat('/en/', partner) else partner_url end, '">') end,
    case when page_id % 12 = 0 then '' else concat('<link rel="alternate" hreflang="x-default" href="', url, '">') end,
    case when page_id % 9 = 0 then concat('<link rel="alternate" hreflang="en_GB" href="', url, '">') else '' end) else '' end,
  array_join(slice(array(
    concat('<meta property="og:title" content="Card ', page_id, '">'), '<meta property="og:description" content="Card &amp; text">',
    concat('<meta property="og:image" content="/img/', page_id, '.png">'), concat('<meta property="og:url" content="', url, '">'),
    '<meta property="OG:type" content="article">'), cast(page_id % 5 + 1 as int), 5), ''),
  case when page_id % 3 = 0 then '' else '<meta name="twitter:card" content="summary">' end,
  case page_id % 4 when 0 then '<script type="application/ld+json">{"@context":{"@type":"No"},"@graph":[{"@type":"Article"},{"@type":["Person","Author"]}]}</script>'
    when 1 then '<script type="application/ld+json">{"@type":"Product","offers":{"@type":"Offer"}}</script>'
    when 2 then '<script type="application/LD+json">{"@type":"Bad",}</script>' else '' end,
  case page_id % 8
    when 0 then concat('<meta name="generator" content="WordPress 6.9.4"><link rel="stylesheet" href="/wp-content/themes/acme-child/style.css?ver=1.2.0">',
      '<script src="/wp-content/plugins/contact-form-7/index.js?ver=5.9"></script><script src="/wp-content/plugins/acme-tools/a.js?ver=2.1"></script>',
      '<script src="/wp-content/plugins/woocommerce/b.js?ver=8.', page_id % 3, '"></script>')
    when 1 then '<script src="/_next/static/chunks/main.js"></script>'
    when 2 then '<meta name="generator" content="Drupal 10 (https://www.drupal.org)">'
    when 3 then concat('<script src="https://code.jquery.com/jquery-3.', page_id % 7, '.1.min.js"></script>')
    when 4 then '<!-- This site is optimized with the Yoast SEO plugin v22.5 - https://example.com -->'
    when 6 then '<meta name="generator" content="Ghost 5.82">' else '' end,
  case when page_id % 2 = 1 then '<meta name="generator" content="WordPressy 9.9"><script src="/not_next/static.js"></script>' else '' end,
  case page_id % 8
    when 0 then concat('<script src="https://www.googletagmanager.com/gtm.js?id=GTM-', case when page_id % 16 = 8 then 'XXXXXXX' else concat('K', lpad(page_id, 6, '0')) end, '"></script>')
    when 1 then concat('<script>gtag("config", "G-', case when page_id % 16 = 9 then 'XXXXXXXXXX' else concat('Q', lpad(page_id, 7, '0')) end, '");</script>')
    when 2 then concat("<script>fbq('init', '", 900000000000000 + page_id, "');</script><noscript><img src=\\"https://www.facebook.com/tr?id=", 900000000000000 + page_id, "&ev=PageView\\"></noscript>")
    when 3 then concat('<script>(function(h){h._hjSettings={hjid:', 70000 + page_id, ',hjsv:6};})(window);</script>')
    when 4 then concat('<script>(function(c,l,a,r,i){})(window, document, "clarity", "script", "ab', lpad(page_id, 8, '0'), '");</script>')
    when 5 then concat('<script defer data-domain="site', page_id, '.example.com" src="https://plausible.io/js/script.js"></script>')
    when 6 then concat('<script>_linkedin_partner_id = "', 5000 + page_id, '";</script><script>fbq("init", "123456789012345");</script>')
    else '<script src="https://cdn.cookielaw.org/scripttemplates/otSDKStub.js"></script>' end)"""

BODY = """concat(
  case page_id % 3 when 0 then '<h1>Extra &lt;one&gt;</h1>' when 1 then '<h2>A <b>bold</b>er</h2><h4>B</h4>' else '<h2> </h2>' end,
  '<a href="https://www.s', page_id % 7, '.example.com/w">Www</a>',
  '<a rel="', case page_id % 3 when 0 then 'nofollow' when 1 then 'UGC' else 'sponsored  noopener' end, '" href="https://out.example.net/x" target=_blank>Out</a>',
  '<a href="mailto:a@example.com">Mail</a><a href="tel:+123">Call</a><a href="#top">Top</a><a href="javascript:void(0)">Js</a>',
  '<a href="/empty"> </a><a href="../img"><img src="/logo.png" alt="Logo" title="L"></a>',
  case page_id % 4 when 0 then '<img src="/a.png">' when 1 then '<img src="/b.png" alt="">' when 2 then '<img data-src="c.png" alt="C" title="See">'
    else '<img src="//cdn.example.net/d.png" alt=" " loading="lazy" srcset="d2.png 2x">' end)"""


def splits(spark: SparkSession) -> int:
    """The given tables are single small files: they are dealt to as many tasks as the session runs at once."""
    return spark.sparkContext.defaultParallelism


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page numbers and whatever else a rule needs; unread columns are pruned from the scan."""
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")


def _site(n: str) -> str:
    return f"concat('https://s', {n} % 7, '.example.com/en/', {n})"


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with an address by rule and the tags above added."""
    df = pages(spark, sf).repartition(splits(spark), "page_id").withColumn("url", F.expr(_site("page_id")))
    df = df.withColumn("partner", F.expr("case when page_id % 2 = 0 then page_id + 1 else page_id - 1 end"))
    df = df.withColumn("partner_url", F.expr(_site("partner")))
    html = f"replace(replace(html, '</head>', concat({HEAD}, '</head>')), '<body>', concat('<body class=\"home wp-custom\">', {BODY}))"
    return df.select("page_id", "url", F.expr(html).alias("html"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One response per page address."""
    headers = """map_filter(map(
        'Content-Type', if(page_id % 9 = 4, 'application/pdf', 'text/html; charset=utf-8'),
        'X-Robots-Tag', case when page_id % 7 = 3 then 'noindex' when page_id % 14 = 5 then 'bingbot: noindex' end,
        'Link', if(page_id % 6 = 5, concat('<https://alt.example.org/', page_id, '>; rel="alternate"; hreflang="de", </x.css>; rel=preload'), null),
        'Server', case page_id % 5 when 0 then 'nginx/1.25.3' when 1 then 'cloudflare' when 2 then 'Apache' when 3 then 'nginxy' end,
        'X-Powered-By', if(page_id % 4 = 0, 'PHP/8.2.1, Express', null)), (k, v) -> v is not null)"""
    return pages(spark, sf).select(
        F.expr(_site("page_id")).alias("url"), "page_id",
        F.expr("case when page_id % 17 = 0 then null when page_id % 10 = 0 then 404 else 200 end").cast("int").alias("status"),
        F.expr("page_id % 10 = 3").alias("redirected"),
        F.expr(f"case when page_id % 10 = 3 then concat({_site('page_id')}, '/final') else {_site('page_id')} end").alias("final_url"),
        F.expr(headers).alias("headers"),
        F.expr(f"""if(page_id % 20 = 3, concat('<html><head><link rel="alternate" hreflang="en" href="', {_site('page_id')}, '"></head><body></body></html>'), null)""").alias("body"),
        F.expr("if(page_id % 17 = 0, 'Timed out', null)").alias("error"),
    ).drop("page_id")


ROBOTS_BODY = (
    "Disallow: /en\\r\\nUser-agent: *\\nDisallow: /private\\n\\nUser-Agent: Googlebot # main\\nSitemap: https://s.example.com/a.xml\\n"
    "user-agent: bingbot\\nDisallow: /en/1\\nAllow: /en/12\\nDisallow: /*5$\\nDisallow:\\nCrawl-delay: 5\\nUser-agent: gptbot\\nDisallow: /\\n"
    "Sitemap: https://s.example.com/b.xml"
)


def robots_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per origin: read, missing, failing or unreachable by the site number."""
    k = pages(spark, sf).select(F.expr("cast(page_id % 7 as int)").alias("k")).distinct()
    return k.select(
        F.expr("concat('https://s', k, '.example.com')").alias("origin"),
        F.expr("case k when 1 then 404 when 2 then 503 when 3 then null else 200 end").cast("int").alias("status"),
        F.expr(f"case when k in (1, 2, 3) then null else '{ROBOTS_BODY}' end").alias("body"),
        F.expr("if(k = 3, 'Timed out', null)").alias("error"),
    )


def page_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests: the container script, a collection hit, and an asset."""
    urls = """array_compact(array(
        if(page_id % 8 = 0, concat('https://www.googletagmanager.com/gtm.js?id=GTM-K', lpad(page_id, 6, '0')), null),
        if(page_id % 8 = 1, concat('https://region1.google-analytics.com/g/collect?v=2&tid=G-Q', lpad(page_id, 7, '0')), null),
        if(page_id % 8 = 2, 'https://connect.facebook.net/en_US/fbevents.js', null),
        if(page_id % 8 = 5, 'https://plausible.io/js/script.js#x', null),
        concat('https://s', page_id % 7, '.example.com/app.js')))"""
    df = pages(spark, sf).select("page_id", F.expr(f"posexplode({urls})").alias("seq", "url"))
    return df.select("page_id", "seq", "url")


def runtime_state(spark: SparkSession, sf: str) -> DataFrame:
    """Runtime: Meta's library missing on half of its pages, a live version elsewhere."""
    rows = """array_compact(array(
        if(page_id % 16 = 2, struct('ran' as space, 'fbq' as key, 'false' as value), null),
        if(page_id % 8 = 3, struct('tech' as space, 'jquery.version' as key, '3.7.1' as value), null),
        if(page_id % 8 = 7, struct('tracker' as space, 'global:OneTrust' as key, cast(null as string) as value), null)))"""
    return pages(spark, sf).select("page_id", F.explode(F.expr(rows)).alias("r")).select("page_id", "r.*")


def render_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered size of the second image of each page."""
    return pages(spark, sf).select(
        "page_id", F.lit(1).alias("idx"), F.lit("img").alias("tag"), F.expr("cast(400 + page_id % 5 * 200 as int)").alias("width"),
        F.lit(300).alias("height"), F.lit(300).alias("shown_width"), F.lit(150).alias("shown_height"), F.expr("page_id % 6 <> 0").alias("shown"),
    )


def containers(spark: SparkSession, sf: str) -> DataFrame:
    """One container per tag-manager page: two tags, a constant and a variable."""
    text = """concat('var data = {"resource":{"macros":[{"function":"__c","vtp_value":"G-C', lpad(page_id, 7, '0'), '"},{"function":"__v"}],',
        '"tags":[{"function":"__googtag","vtp_tagId":["macro",0]},{"function":"__hjtc","vtp_hotjar_site_id":["macro",1]},',
        '{"function":"__html","vtp_html":"fbq(\\\\"init\\\\", \\\\"', 800000000000000 + page_id, '\\\\")"}]}};')"""
    cid = "concat('GTM-K', lpad(page_id, 6, '0'))"
    return pages(spark, sf).where("page_id % 8 = 0").select(
        F.expr(cid).alias("container_id"), F.expr(f"concat('https://www.googletagmanager.com/gtm.js?id=', {cid})").alias("url"),
        F.expr(text).alias("text"), F.lit(None).cast("string").alias("error"),
    )


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """CMS answers for the pages that run it."""
    origin = "concat('https://s', page_id % 7, '.example.com')"
    rows = f"""array(
        struct('feed' as kind, cast(null as string) as slug, concat({origin}, '/feed/') as url, '<rss><generator>https://wordpress.org/?v=6.9.4</generator></rss>' as text),
        struct('rest' as kind, cast(null as string) as slug, concat({origin}, '/wp-json/?_fields=namespaces') as url,
               '{{"namespaces":["oembed/1.0","wp/v2","contact-form-7/v1","acme/v1","yoast/v1"]}}' as text),
        struct('theme' as kind, 'acme-child' as slug, concat({origin}, '/wp-content/themes/acme-child/style.css') as url,
               '/*\\nTheme Name: Acme Child\\nTemplate: acme\\nVersion: 1.4\\n*/' as text),
        struct('opml' as kind, cast(null as string) as slug, concat({origin}, '/wp-admin/wp-links-opml.php') as url, '<!-- generator="WordPress/6.1" -->' as text))"""
    df = pages(spark, sf).where("page_id % 8 = 0").select("page_id", F.explode(F.expr(rows)).alias("p"))
    return df.select("page_id", "p.*", F.lit(False).alias("capped"), F.lit(None).cast("string").alias("error"))


def raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup answers per page number: every shape an answer can take."""
    return pages(spark, sf).select(
        F.expr("concat('k', page_id)").alias("key"),
        F.expr("case page_id % 3 when 0 then 'wp-core' when 1 then 'wp-plugin' else 'wp-theme' end").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.expr("cast(if(page_id % 5 = 0, 404, 200) as int)").alias("status"),
        F.expr("""case when page_id % 5 = 0 then null when page_id % 7 = 0 then 'oops' when page_id % 3 = 0 then
            '{"offers":[{"version":"7.1.3"},{"version":"6.9.10"},{"version":"7.1.3"},{"version":"nightly"}]}'
            when page_id % 11 = 0 then '{"error":"Plugin not found."}' else concat('{"version":"1.', page_id, '","name":"Theme ', page_id, '"}') end""").alias("text"),
        F.expr("if(page_id % 5 = 0, 'HTTP 404', null)").alias("error"), F.lit(False).alias("capped"),
        F.expr("timestamp'2026-01-02 00:00:00' - make_dt_interval(0, cast(page_id % 24 as int))").alias("fetched_at"),
    )


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """Known latest versions, in the read shape."""
    keys = """array(
        struct('wp-core' as key, cast(null as string) as version, array('7.1.3', '6.9.10', '6.8.7') as offers, cast(null as string) as theme_name),
        struct('npm:jquery' as key, '3.5.1' as version, cast(null as array<string>) as offers, cast(null as string) as theme_name),
        struct('wp-plugin:contact-form-7' as key, '6.0' as version, cast(null as array<string>) as offers, cast(null as string) as theme_name),
        struct('wp-theme:acme-child' as key, '9.0' as version, cast(null as array<string>) as offers, 'Another Theme' as theme_name))"""
    # Every page gives an answer to one of the keys, the first ones an outdated version, and one to a key of its own.
    rows = F.expr(f"array(element_at({keys}, cast(page_id % 4 + 1 as int)), struct(concat('wp-plugin:other-', page_id) as key, '1.0' as version, cast(null as array<string>) as offers, cast(null as string) as theme_name))")
    df = pages(spark, sf).select("page_id", F.explode(rows).alias("a")).select("page_id", "a.*")
    old = F.col("page_id") < 4
    return df.select(
        "key", F.lit("x").alias("kind"), F.lit(None).cast("string").alias("name"), F.when(old & F.col("version").isNotNull(), "0.0.1").otherwise(F.col("version")).alias("version"), "offers",
        F.lit(False).alias("unlisted"), "theme_name", F.lit(None).cast("string").alias("error"), F.expr("timestamp_seconds(1767225600 + page_id)").alias("fetched_at"),
    )


def serp_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Result pages: questions in three markups, with a repeat."""
    html = """concat('<div data-q="What is page ', page_id, '?"></div><div data-q="WHAT IS PAGE ', page_id, '?"></div>',
        '<div class="related-question-pair"><div role="button" aria-expanded="true">Why ', page_id, '?</div><div>Because of ', page_id,
        '. <a href="https://www.google.com/x">g</a><a href="https://src.example.org/', page_id, '"><h3>Source ', page_id, '</h3></a></div></div>',
        '<div><div><h2>People also ask</h2></div><div aria-expanded="false">How ', page_id, '?</div><div aria-expanded="false">Who ', page_id, '?</div></div>')"""
    url = """concat('https://www.google.', case page_id % 4 when 0 then 'com' when 1 then 'co.uk' when 2 then 'fr' else 'example.com' end,
        case when page_id % 5 = 0 then '/maps' else '/search' end, '?q=', page_id)"""
    return pages(spark, sf).select("page_id", F.expr(url).alias("url"), F.expr(html).alias("html"))


def microdata_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched pages plus one nested microdata item."""
    item = """concat('<body><div itemscope itemtype="https://schema.org/Product" itemid="urn:', page_id, '"><span itemprop="name">P <b>', page_id,
        '</b></span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="', page_id, '.50"><link itemprop="url" href="/o/', page_id,
        '"></div><span itemprop="tag">a</span><span itemprop="tag">b</span></div>')"""
    df = pages(spark, sf).withColumn("url", F.expr(_site("page_id")))
    return df.select("page_id", "url", F.expr(f"replace(html, '<body>', {item})").alias("html"))


def version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Version pairs spelled from page numbers."""
    v = lambda n: f"""concat(if({n} % 5 = 0, 'v', ''), {n} % 4, '.', {n} % 11, case {n} % 3 when 0 then '' else concat('.', {n} % 13) end,
        case {n} % 7 when 0 then concat('-rc.', {n} % 10) when 1 then '-beta' else '' end, if({n} % 6 = 0, '+b1', ''))"""
    return pages(spark, sf).select("page_id", F.expr(v("page_id")).alias("a"), F.expr(v("(page_id * 7 + 3)")).alias("b"))


def nested_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a counted nest in front: left-out end tags, stray ones, void elements, and every tag closed, by page number."""
    left_out = """concat('<div class="a"><ul class="menu"><li>One<li><a href="/n/x', page_id, '">X</a><ul><li><a href="/n/y">Y</a></ul><li>Three</ul>',
        '<p>Text<br><a href="/n/z">Z</a><div><a href="/n/w">W</a></div></div><span><a href="/n/out">Out</a></span>')"""
    closed = """concat('<div class="a"></b><ul class="menu"><li>One</li><li><a href="/n/x', page_id, '">X</a><ul><li><a href="/n/y">Y</a></li></ul></li></section><li>Three</li></ul>',
        '<p>Text<img src="/i.png"><a href="/n/z">Z</a></p></p><div><a href="/n/w">W</a></div></div><!-- <ul class="menu"><a href="/n/no">No</a></ul> --><span><a href="/n/out">Out</a></span>')"""
    df = pages(spark, sf).withColumn("url", F.expr(_site("page_id")))
    return df.select("page_id", "url", F.expr(f"concat(if(page_id % 2 = 0, {left_out}, {closed}), html)").alias("html"))
