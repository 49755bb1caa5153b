"""Cases that a reviewer found."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlaudit.functions import html as H
from crawlaudit.operators import corpus, elements as EL

PAGE = "<html><head><title>{}</title></head><body>{}</body></html>"


def test_pages_of_one_address_are_all_audited(spark, tmp_path):
    rows = [(1, "https://a.example/x", PAGE.format("One", '<a href="/y">Y</a>')), (2, "https://a.example/x", PAGE.format("Two", "")), (3, None, PAGE.format("Three", ""))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["incremental_audit"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.url, r.title, r.links) for r in got) == [(1, rows[0][1], "One", 1), (2, rows[0][1], "Two", 0), (3, None, "Three", 0)]


def test_attributes_of_a_tag_are_read_once(spark):
    tags = ['<a HREF="/x?a=1&amp;b" data-x = \'y"z\' href=second hidden title=>', "<p>", "<p / =odd q>", '<img alt="a\n" src=b/>']
    want = [{"href": "/x?a=1&b", "data-x": 'y"z', "hidden": "", "title": ""}, {}, {"": "", "q": ""}, {"alt": "a\n", "src": "b/"}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t string").select("i", H.attributes(F.col("t")).alias("a"))
    assert [r.a for r in df.orderBy("i").collect()] == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_are_dealt_once_and_read_once(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<ul><li>a<li>b</ul>")], "page_id long, url string, html string").repartition("page_id")
    rows = EL.elements(EL.markup(pages))
    plan = _plan(EL.owned(EL.owned(rows, F.col("name") == "ul"), F.col("name") == "li", "item", tag_of=F.col("tag")))
    assert plan.count("Exchange") == 1 and plan.count("Generate posexplode") == 1 and "unboundedfollowing" not in plan


def test_many_children_of_one_parent(spark):
    n = 3000
    html = "<div>" + "".join(f"<p id=p{i}>t<br>" for i in range(n)) + "</div>"
    rows = EL.elements(EL.markup(spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string")))
    got = sorted((r.start, r.end) for r in rows.where("name = 'p'").collect())
    assert len(got) == n and all(e == s for (_, e), (s, _) in zip(got, got[1:])) and got[-1][1] == 3 * n + 1


def test_paths_pick_what_single_selectors_pick(spark):
    rng = random.Random(25)
    grow = lambda d: "".join(f"<{t} id={rng.random()}>{grow(d - 1)}</{t}>" if d else "x" for t in rng.choices(["a", "b", "p", "ul"], k=rng.randint(0, 3)))
    pages = spark.createDataFrame([(p, "http://a.example/", grow(4)) for p in range(20)], "page_id long, url string, html string")
    rows = EL.elements(EL.markup(pages)).cache()
    is_ = {n: F.col("name") == n for n in ("a", "b", "ul")}
    paths = {"ul a": ("ul", " ", "a"), "b > a": ("b", ">", "a"), "ul ul a": ("ul", " ", "ul", " ", "a"), "ul a > b": ("ul", " ", "a", ">", "b"), "b": ("b",)}
    got = EL.select_paths(rows, is_, paths).groupBy("selector").agg(F.sort_array(F.collect_list("tag")).alias("tags")).collect()
    tags = lambda df: sorted(r.tag for r in df.collect())
    flagged = lambda df: rows.join(df.select("page_id", "start", F.lit(True).alias("_in")), ["page_id", "start"], "left")
    want = {"ul a": tags(EL.select_within(rows, is_["ul"], is_["a"])), "b > a": tags(EL.select_children(rows, is_["b"], is_["a"])), "b": tags(rows.where(is_["b"])),
            "ul ul a": tags(EL.select_within(flagged(EL.select_within(rows, is_["ul"], is_["ul"])), F.col("_in"), is_["a"])),
            "ul a > b": tags(EL.select_children(flagged(EL.select_within(rows, is_["ul"], is_["a"])), F.col("_in"), is_["b"]))}
    assert {r.selector: r.tags for r in got} == {s: t for s, t in want.items() if t} and len(got) == 5


def test_anchors_are_the_least_runs_of_their_windows(spark):
    rng = random.Random(20)
    texts = [[rng.choice("abcd" if i % 2 else "abcdefghijklmnopqrstuvwxyz") for _ in range(n)] for i, n in enumerate([1, 3, 4, 7, 8, 9, 12, 13, 40, 200])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, w array<string>")
    made = corpus.winnowed(df, "i", "w", [0, 1, 2])
    got = {(r.i, r.level, r.place): r.anchor for r in made.collect()}
    runs = spark.createDataFrame([(i, p, t[p:p + 4]) for i, t in enumerate(texts) for p in range(len(t) - 3)], "i int, p int, r array<string>")
    of_words = F.xxhash64(*[F.xxhash64(F.get("r", F.lit(j))) for j in range(4)])
    h = {(r.i, r.p): r.h for r in runs.select("i", "p", of_words.alias("h")).collect()}
    want = set()
    for i, t in enumerate(texts):
        for s in range(len(t) - 7):
            low = min(h[i, p] for p in range(s, s + 5))
            want |= {(i, 1, p + 1) for p in range(s, s + 5) if h[i, p] == low}
    assert {k for k in got if k[1] == 1} == want and all(got[i, 1, p] == h[i, p - 1] for i, _, p in want)
    assert {k for k in got if k[1] == 0} == {(i, 0, p) for i, _, p in want if p + 7 <= len(texts[i])}
    assert {k for k in got if k[1] == 2} == {(i, 2, p + 1) for i, t in enumerate(texts) for p in range(len(t))}
    # Hashes of words come before the rows, nothing is looked at in a lambda after that.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") == 1
    passages = spark.createDataFrame([(n, " ".join(texts[9][50:50 + n])) for n in range(1, 40)], "item_id int, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None)], "doc_id int, text string")
    counts = {r.item_id: r.copies for r in corpus.passage_copy_counts(passages, docs).collect()}
    held = lambda n: sum(f" {' '.join(texts[9][50:50 + n])} " in f" {' '.join(t)} " for t in texts)
    assert counts == {n: held(n) for n in range(1, 40)}
