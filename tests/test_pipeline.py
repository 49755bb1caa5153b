"""Small-crawl behaviour that the registered queries do not show."""

import datetime as dt

from pyspark.sql import functions as F

from crawlaudit.operators import cms, corpus, export, extract as X, page as A, robots as R
from crawlaudit.operators import skew, structured as SD, trackers as TR
from crawlaudit.plans import audit
from crawlaudit.streaming import incremental as INC

PAGE = """<!doctype html><html lang="fr"><head><title> A &amp; B </title><!-- <title>no</title> --><svg><title>svg</title></svg>
<meta name=" Description " content="it's &quot;ok&quot;"><meta name=description content=second><base href="http://Ex.com:80/dir/page">
<link rel="Canonical nofollow" href="/a/../b/./c?x=1#f"><script>var a="<h1>no</h1>";</script><noscript><img src=n.gif></noscript>
<script src="a.js" async data-domain="x.org"></script></head><body class="home"><h1>Hello <b>big</b>world<br>there</h1><h3></h3>
<a href="x y.html" rel="NoFollow  ugc"><img src=i.png alt="alt text"></a><a href=/z title=lab></a><a>none</a><area href="#top">
<img data-src="q.jpg" alt="" loading=lazy srcset="a 1x"><img></body></html>"""


def crawl(spark, *pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")


def test_page_record(spark):
    r = X.page_records(crawl(spark, ("https://www.Ex.com/p/q.html", PAGE)), "head", "headings", "links", "images", "scripts", "noscript", "comments").first()
    assert (r.head.title, r.head.title_count, r.head.description, r.head.description_count) == ("A & B", 1, 'it\'s "ok"', 2)
    assert [tuple(c) for c in r.head.canonicals] == [("http://ex.com/b/c?x=1#f", "/a/../b/./c?x=1#f")]
    assert [(h.level, h.text) for h in r.headings] == [(1, "Hello bigworld there"), (3, "")]
    assert [(l.href, l.text, l.text_source, l.rel) for l in r.links] == [
        ("http://ex.com/dir/x%20y.html", "alt text", "image alt", "nofollow ugc"), ("http://ex.com/z", "lab", "label", ""), ("http://ex.com/dir/page#top", "", "text", "")]
    assert [(i.src, i.raw, i.alt) for i in r.images] == [("http://ex.com/dir/i.png", "i.png", "alt text"), ("http://ex.com/dir/q.jpg", "q.jpg", ""), ("", "", None)]
    assert [tuple(s) for s in r.scripts] == [("http://ex.com/dir/a.js", ' async="" data-domain="x.org"')]
    assert (r.noscript, r.comments) == (["<img src=n.gif>"], ["<title>no</title>"])


def test_limits_are_optional(spark):
    html = "<body>" + "".join(f"<h2>{i}</h2><script>var x{i};</script>" for i in range(9))
    pages = crawl(spark, ("https://a.org/", html))
    full = X.page_records(pages, "headings", "inline").first()
    cut = X.page_records(pages, "headings", "inline", limits={"children": 4, "scripts_chars": 20}).first()
    assert (len(full.headings), len(full.inline)) == (9, 9)
    assert (len(cut.headings), cut.headings_total, sum(map(len, cut.inline))) == (4, 9, 20)


def test_verdict_keeps_unknown_apart(spark):
    pages = crawl(spark, ("https://a.org/x", "<head><meta name=robots content=noindex></head>"), ("https://a.org/y", ""))
    got = {r.page_id: r for r in audit.indexability(pages).collect()}
    assert got[0].reasons == ["noindex in meta robots"] and not got[0].indexable
    assert got[1].indexable and got[1].unknown == ["HTTP headers", "robots.txt"]


def test_robots_specific_group_does_not_fall_back(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: googlebot\nAllow: /ok"
    files = spark.createDataFrame([("https://a.org", 200, body, None)], "origin string, status int, body string, error string")
    pages = crawl(spark, ("https://A.org/other", ""), ("https://a.org/robots.txt", ""), ("https://b.org/", ""))
    got = {(r.page_id, r.agent): r.allowed for r in R.check_urls(pages, files, ["Googlebot", "otherbot"]).collect()}
    assert got == {(0, "googlebot"): True, (0, "otherbot"): False, (1, "googlebot"): True, (1, "otherbot"): True, (2, "googlebot"): None, (2, "otherbot"): None}


def test_hot_keys_are_salted_without_loss(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = left.join(right, "k", "left").select("id", "v")
    salted = skew.lookup_join(left, right, ["k"], hot_share=0.05, salts=8).select("id", "v")
    assert salted.count() == 1000 and salted.exceptAll(plain).count() == 0


def test_passages_against_brute_force(spark):
    docs = [(0, "the quick “brown” fox jumps over the lazy dog again and again"), (1, "lazy dog"), (2, "a b c"), (3, "the quick brown fox jumps over the lazy dogs"), (4, "x a  b c")]
    items = [(0, "the quick brown fox jumps over the lazy dog"), (1, "lazy dog"), (2, "“lazy” dog"), (3, "a b c"), (4, "  ")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: " ".join("".join(" " if c in "\"“”„«»" else c for c in t).split())
    want = {i: sum(f" {norm(t)} " in f" {norm(x)} " for _, x in docs) if norm(t) else 0 for i, t in items}
    assert {r.item_id: r.copies for r in corpus.passage_copy_counts(p, d).collect()} == want


def test_no_runtime_is_not_a_failed_runtime(spark):
    sig = spark.createDataFrame([(0, "inline", 0, None, "x")], "page_id long, kind string, seq int, key string, value string")
    req = spark.createDataFrame([(0, 0, "https://connect.facebook.net/en_US/fbevents.js")], "page_id long, seq int, url string")
    run = spark.createDataFrame([(0, "ran", "fbq", "false")], "page_id long, space string, key string, value string")
    loaded = TR.detect_trackers(sig, req).first()
    blocked = TR.detect_trackers(sig, req, run).first()
    assert (loaded.status, loaded.id_note) == ("loaded", "No ID found")
    assert (blocked.status, blocked.evidence) == ("in-page", ["fbevents.js requested, never ran (blocked?)"])


def test_likely_core_version_from_theme_assets(spark):
    html = """<body class="wp-theme-acme"><link rel=stylesheet href="/wp-content/themes/acme/style.css?ver=6.4.2">
    <link rel=stylesheet href="/wp-content/themes/acme/css/bootstrap.css?ver=5.3.1">"""
    pages = crawl(spark, ("https://a.org/", html))
    probes = spark.createDataFrame([(0, "theme", "acme", "https://a.org/wp-content/themes/acme/style.css", "Theme Name: Acme\nVersion: 1.0", False, None)],
                                   "page_id long, kind string, slug string, url string, text string, capped boolean, error string")
    d = cms.detect(X.staged_signals(pages), probes=probes)
    row = d["tech"].where("tech = 'wordpress'").first()
    assert (row.version, row.confidence) == ("6.4.2", "likely")
    assert d["themes"].first().version == "1.0"


def test_jsonld_is_strict(spark):
    html = '<script type="application/ld+json">{"a":1} x</script><script type="application/ld+json">{"a":NaN}</script><script type="application/ld+json">[{"@type":"A","x":{"@type":["B","A"]}}]</script>'
    blocks = SD.jsonld_blocks(X.page_records(crawl(spark, ("https://a.org/", html)), "jsonld"))
    assert [b.ok for b in blocks.orderBy("idx").collect()] == [False, False, True]
    assert sorted((r.idx, r.type) for r in SD.schema_types(blocks).collect()) == [(2, "A"), (2, "B")]


def test_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", 'a"b'), (2, None, "x,y"), (3, "é", "l1\nl2")], "i int, a string, b string")
    export.write_exact_csv(df, str(tmp_path / "out"), {"a": "A", "b": "B"}, ["i"])
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.decode() == "﻿A,B\r\n'=1+1,\"a\"\"b\"\r\n,\"x,y\"\r\né,\"l1\nl2\"\r\n"


def test_older_snapshot_never_wins(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    log = INC.BatchLog(spark, str(tmp_path / "t"), "url string, collected_at timestamp, n int")
    rows = lambda *r: spark.createDataFrame(list(r), log.schema)
    assert log.read().count() == 0
    log.append(rows(("a", at(3), 3), ("b", at(1), 1)), 0)
    log.append(rows(("a", at(2), 2), ("b", at(5), 5)), 1)
    log.append(rows(("a", at(2), 2), ("b", at(5), 5)), 1)  # a retry
    log.compact()
    log.append(rows(("c", at(1), 7), ("b", at(4), 4)), 2)
    assert {r.url: r.n for r in log.read().collect()} == {"a": 3, "b": 5, "c": 7}


def test_filters_reach_the_scan_and_pages_stay_put(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = X.page_records(pages.where("url > 'https://m'"), "links")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(url), GreaterThan(url,https://m)]" in plan and "Exchange" not in plan
    domains = corpus.pages_per_domain(pages)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in domains


def test_issue_rules(spark):
    df = spark.createDataFrame([([(0, 2, "a"), (1, 5, "")],)], "h array<struct<idx:int,level:int,text:string>>")
    got = [tuple(i) for i in df.select(A.heading_issues(F.col("h"))).first()[0]]
    assert got == [("error", "No H1 on the page", None), ("warn", "Skips from H2 to H5", 1), ("warn", "1 empty heading", None)]
