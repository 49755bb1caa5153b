"""Nothing is lost, doubled or piled up: late pages, repeated side rows, long values, hot and missing keys."""

import random

from pyspark.sql import functions as F

from crawlaudit.functions import jsontext as J
from crawlaudit.operators import cms, containers as K, corpus, extract as X, hreflang as HL, latest as L, robots as R, serp, skew, structured as SD
from crawlaudit.plans import audit
from crawlaudit.sources import tables
from crawlaudit.streaming import incremental as INC

HEAD = "<html><head><title>{}</title></head><body>{}</body></html>"
RESPONSES = "url string, status int, redirected boolean, final_url string, headers map<string,string>, body string, error string, fetched_at timestamp"


def test_late_pages_are_kept_over_three_batches(spark, tmp_path):
    schema = "page_id bigint, url string, html string, collected_at timestamp"
    for n, day in enumerate((3, 1, 2)):
        rows = spark.createDataFrame([(n, f"https://a.example/{n}", HEAD.format(day, "")), (9, "https://a.example/same", HEAD.format(day, ""))], "page_id bigint, url string, html string")
        rows.withColumn("collected_at", F.expr(f"timestamp'2026-01-0{day} 00:00:00'")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = INC.BatchLog(spark, str(tmp_path / "log"), "url string, collected_at timestamp, title string")
    work = lambda pages: X.page_records(pages, "head").select("url", "collected_at", F.col("head.title").alias("title"))
    INC.run_incremental(INC.page_stream(spark, str(tmp_path / "in"), 1), work, log, str(tmp_path / "checkpoint")).awaitTermination()
    want = {"https://a.example/same": "3", "https://a.example/0": "3", "https://a.example/1": "1", "https://a.example/2": "2"}
    assert {r.url: r.title for r in log.read().collect()} == want
    log.compact()
    assert {r.url: r.title for r in log.read().collect()} == want and log._finished("b") == []


def test_repeated_side_rows_leave_one_row_per_page(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x", HEAD.format("t", "")), (2, None, HEAD.format("t", ""))], "page_id bigint, url string, html string")
    row = lambda status, day: ("https://a.example/x", status, False, None, {"X-Robots-Tag": "noindex"} if status == 200 else {}, None, None, None if day is None else day)
    rows = [row(404, None), row(404, None), row(200, None)]
    responses = spark.createDataFrame(rows, RESPONSES).withColumn("fetched_at", F.expr("timestamp_seconds(status)"))
    files = spark.createDataFrame([("https://a.example", 200, f"User-agent: *\nDisallow: /{p}", None) for p in "xyz"], "origin string, status int, body string, error string")
    got = {r.page_id: r for r in audit.indexability(pages, responses, files).collect()}
    assert len(got) == 2 and got[1].status == 404
    assert audit.indexability(pages, responses, files).count() == R.check_urls(pages, files).count() == 2
    again = {r.page_id: r for r in audit.indexability(pages, responses.orderBy(F.desc("status")), files).collect()}
    assert again == got


def test_hot_and_missing_keys_are_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    looked = spark.createDataFrame([("hot", 1), ("2", 2), (None, 3)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        joined = skew.lookup_join(rows, looked, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 500
        assert {(r.k, r.v): r["count"] for r in joined.where("v is not null").groupBy("k", "v").count().collect()} == {("hot", 1): 1000, ("2", 2): 1}
        assert skew.lookup_join(rows, looked, ["k"], "inner").count() == 1001
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_phrases_are_compared(spark):
    same = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame([(1, same + " one"), (2, same + " two"), (3, same + " one"), (4, None), (5, "")], "page_id bigint, t string")
    assert [tuple(r) for r in corpus.phrase_copies(texts, F.col("t")).collect()] == [(same + " one", 2, 1)]
    docs = spark.createDataFrame([(1, f"a {same} one b"), (2, f'a "{same}" two'), (3, "short words"), (4, None)], "doc_id bigint, text string")
    passages = spark.createDataFrame([(1, same + " one"), (2, same + " three"), (3, "short"), (4, "words here"), (5, None)], "item_id bigint, text string")
    assert {(r.item_id, r.copies) for r in corpus.passage_copy_counts(passages, docs).collect()} == {(1, 1), (2, 0), (3, 1), (4, 0), (5, 0)}


def test_long_values_are_not_cut(spark):
    body = f"<!--{'c' * 5000} end--><script src=/a.js data-id='{'d' * 900} end'></script>"
    pages = spark.createDataFrame([(1, "https://a.example/", HEAD.format("t", body))], "page_id bigint, url string, html string")
    r = X.page_records(pages, "comments", "scripts").first()
    assert r.comments[0].endswith(" end") and r.scripts[0]["attrs"].endswith(' end"')
    cut = X.page_records(pages, "comments", "scripts", limits=X.COLLECTOR_LIMITS).first()
    assert len(cut.comments[0]) == 400 and len(cut.scripts[0]["attrs"]) < 500


def test_every_plugin_is_looked_up(spark):
    plugins = spark.range(12).select(F.lit(1).cast("long").alias("page_id"), F.concat(F.lit("p"), "id").alias("wporg"), (F.col("id") + 1).cast("int").alias("row_no"))
    tech = spark.createDataFrame([], "page_id long, tech string, version string, npm string")
    themes = spark.createDataFrame([(1, f"t{i}", i) for i in range(1, 4)], "page_id long, wporg string, row_no int")
    assert L.lookup_targets(tech, plugins, themes).count() == 15
    assert L.lookup_targets(tech, plugins, themes, max_plugins=10, max_themes=2).count() == 12
    text = '{"namespaces":["' + "n" * 300 + '/v1","wp/v2"]}'
    probes = spark.createDataFrame([(1, "rest", text), (2, "rest", text[:-1])], "page_id long, kind string, text string")
    assert {(r.page_id, len(r.ns)) for r in cms.namespaces(probes).where("pos = 0").collect()} == {(1, 303), (2, 303)}


def test_strict_json_and_deep_types(spark):
    cases = {
        '{"a":1}': True, ' [1, {"b":null}] ': True, '{"a":1} x': False, '{"a":NaN}': False, '{"a":1,"a":2}': True, "{'a':1}": False, "[1,2,]": False, '{"a":1}{"b":2}': False,
        '{"a":01}': False, '"s"': True, "": False, "null": True, '{"a":"x\ty"}': False, '{"a":"\\u00e9\\n"}': True, '{"a":"\\x"}': False, "12 13": False, '{"a":[}': False,
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", J.is_valid(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == cases
    deep = '{"@type":"Leaf \\"x\\""}'
    for _ in range(30):
        deep = '{"n":[' + deep + "]}"
    blocks = [(1, 0, deep), (1, 1, '{"@context":{"@type":"No","k":{"@context":{"@type":"No"},"@type":"No"}},"@type":["A","B","A"],"p":{"@type":"C","@context":"https://x"},"q":"@type"}')]
    types = SD.schema_types(spark.createDataFrame(blocks, "page_id long, idx int, json string").withColumn("ok", F.lit(True)))
    assert sorted((r.idx, r.type) for r in types.collect()) == [(0, 'Leaf "x"'), (1, "A"), (1, "B"), (1, "C")]


def test_container_constants_follow_the_macros(spark):
    text = 'x var data = {"resource":{"macros":[{"function":"__c","vtp_value":"G-\\"1"},{"function":"__v"}],"tags":[["macro",0],["macro", 1],["macro",7]]}}; {"more":1}'
    r = spark.createDataFrame([(text,), ("var data = {broken",), (None,)], "t string").select(K.container_data(F.col("t")).alias("d"), K.resolve_constants(F.col("t")).alias("r")).collect()
    assert r[0].d.endswith('["macro",7]]}}') and '"tags":["G-\\"1",["macro", 1],["macro",7]]' in r[0].r
    assert (r[1].d, r[1].r, r[2].d, r[2].r) == (None, "var data = {broken", None, None)


def test_questions_in_nested_blocks(spark):
    block = '<div class="x related-question-pair"><div><div role="button" aria-expanded="{}">Why <b>{}</b>?</div><div>Since <div>then</div>.</div></div></div><p>after</p>'
    html = block.format("true", 1) + block.format("false", 2) + '<div data-initq="Why 1?"></div><h2>Andere Fragen</h2><span aria-expanded="false">Who?</span><h2>Else</h2><i aria-expanded="false">No</i>'
    got = serp.people_also_ask(spark.createDataFrame([(1, "https://www.google.de/search?q=x", html)], "page_id long, url string, html string"))
    assert [(r.idx, r.question, r.answer) for r in got.orderBy("idx").collect()] == [(0, "Why 1?", ""), (1, "Why 2?", ""), (2, "Who?", "")]


def test_targets_outside_the_crawl_are_unknown_or_read(spark):
    link = '<link rel="alternate" hreflang="en" href="{}">'
    pages = spark.createDataFrame([(1, "https://a.example/1", "<html><head>" + link.format("https://b.example/1") + link.format("https://b.example/2") + "</head></html>")], "page_id bigint, url string, html string")
    answer = lambda n, body: (f"https://b.example/{n}", 200, False, None, {"Content-Type": "text/html"}, body, None, None)
    responses = spark.createDataFrame([answer(1, "<html><head>" + link.format("https://a.example/1") + "</head></html>"), answer(2, None)], RESPONSES)
    got = HL.checked_alternates(X.page_records(pages, "head", "hreflang"), responses)
    assert {(r.href, r.return_link) for r in got.collect()} == {("https://b.example/1", True), ("https://b.example/2", None)}


def test_newest_row_wins(spark):
    rows = spark.createDataFrame([("a", 1, {"x": str(random.random())}), ("a", 2, {}), ("b", 1, None)], "url string, fetched_at int, headers map<string,string>")
    assert sorted((r.url, r.fetched_at) for r in tables.newest(rows, "url").collect()) == [("a", 2), ("b", 1)]


def test_detection_folds_inside_buckets(spark):
    """Facts are dealt to buckets of pages once; what follows has no exchange, and its tables go when they are dropped."""
    plugin = "https://a.example/wp-content/plugins/acme-tools/x.js?ver=1.{}"
    rows = [(p, "script", i, "", plugin.format(i % 2)) for p in range(40) for i in range(3)] + [(p, "body", 0, "", "wp-theme-acme") for p in range(40)]
    signals = spark.createDataFrame(rows, "page_id long, kind string, seq int, key string, value string")
    found = cms.detect(signals)
    plan = found["themes"].join(found["core"], "page_id", "left").groupBy("page_id", "slug").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert {(r.page_id, r.id, r.version) for r in found["plugins"].collect()} == {(p, "slug:acme-tools", "1.0") for p in range(40)}
    assert found["themes"].where("slug = 'acme'").count() == 40
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")}
    skew.drop_staged(spark)
    assert before and not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]
