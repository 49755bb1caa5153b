"""Refinement by change propagation: which pages each batch derives, and that the end equals a derivation of everything."""

from pyspark.sql import functions as F

from crawlaudit.streaming import incremental as INC
from crawlaudit.streaming.refine import Refinery, Side


def refinery(spark, path):
    """A page's words are looked up in a table of meanings."""
    extract = lambda pages: pages.select("page_id", F.split("html", " ").alias("words"))

    def derive(pages, facts, sides):
        words = facts.select("page_id", F.explode("words").alias("word"))
        known = words.join(sides["meanings"].select("word", "meaning"), "word", "left")
        key = F.struct(F.lit("meanings").alias("source"), F.col("word").alias("key"))
        return known.groupBy("page_id").agg(F.array_sort(F.collect_set("meaning")).alias("result"), F.array_sort(F.collect_set(key)).alias("keys"))

    sides = {"meanings": Side("word string, meaning string", "word")}
    return Refinery(spark, path, sides, "page_id bigint, words array<string>", "array<string>", extract, derive)


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, at long").select("page_id", "url", "html", F.timestamp_seconds("at").alias("collected_at"))


def meanings(spark, *rows):
    return spark.createDataFrame(rows, "word string, meaning string, at long").select("word", "meaning", F.timestamp_seconds("at").alias("fetched_at"))


def results(r):
    return {row.url: row.result for row in r.read().collect()}


def derived(r):
    return {row.step: row.pages for row in r.derived().collect()}


def test_only_touched_pages_are_derived(spark, tmp_path):
    r = refinery(spark, str(tmp_path))
    r.add_pages(pages(spark, (1, "a", "x y", 10), (2, "b", "y z", 10), (3, "c", "q", 10)), 0)
    assert results(r) == {"a": [], "b": [], "c": []}
    r.add_side("meanings", meanings(spark, ("y", "why", 5), ("w", "unused", 5)), 0)
    assert results(r) == {"a": ["why"], "b": ["why"], "c": []} and derived(r) == {1: 3, 2: 2}
    # What is older, repeated or of no page derives nothing.
    r.add_side("meanings", meanings(spark, ("y", "old", 1), ("v", "nothing", 9)), 1)
    r.add_side("meanings", meanings(spark, ("y", "why", 5)), 2)
    assert derived(r) == {1: 3, 2: 2}
    r.add_side("meanings", meanings(spark, ("z", "zed", 6), ("y", "because", 7)), 3)
    assert results(r) == {"a": ["because"], "b": ["because", "zed"], "c": []} and derived(r) == {1: 3, 2: 2, 5: 2}
    # A newer load replaces a page and what it looked up; an older one, or none, does nothing.
    r.add_pages(pages(spark, (4, "a", "z", 20), (5, "b", "q", 1), (6, "d", "y", 1)), 1)
    assert results(r) == {"a": ["zed"], "b": ["because", "zed"], "c": [], "d": ["because"]} and derived(r)[6] == 2
    r.add_side("meanings", meanings(spark, ("y", None, 8)), 4)
    assert results(r) == {"a": ["zed"], "b": ["zed"], "c": [], "d": []} and derived(r)[7] == 2


def test_a_retried_batch_does_its_work_once(spark, tmp_path):
    r = refinery(spark, str(tmp_path))
    r.add_pages(pages(spark, (1, "a", "x y", 10), (2, "b", "z", 10)), 0)
    batch = meanings(spark, ("x", "ex", 5))
    r.add_side("meanings", batch, 0)
    # The batch failed behind its log: its results are gone, the change is still found, the step keeps its number.
    INC.BatchLog(spark, r.results.path, r.results.schema).append(r.results.all_rows().limit(0), 2)
    assert results(r)["a"] == []
    r.add_side("meanings", batch, 0)
    assert results(r) == {"a": ["ex"], "b": []} and derived(r) == {1: 2, 2: 1}
    r.add_pages(pages(spark), 1)
    assert results(r) == {"a": ["ex"], "b": []}


def test_streams_end_like_one_derivation(spark, tmp_path):
    r = refinery(spark, f"{tmp_path}/state")
    words = [chr(97 + i % 7) for i in range(40)]
    loads = [(i, f"u{i % 25}", f"{words[i]} {words[i * 3 % 40]}", i) for i in range(40)]
    facts = [(w, f"{w}{n}", n) for n in range(3) for w in "abcdef"]
    for n in range(2):
        for source, rows in (("pages", pages(spark, *loads[n::2])), ("meanings", meanings(spark, *facts[n::2]))):
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{source}")
            r.start(source, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{source}")).awaitTermination()
    newest = {u: html for _, u, html, _ in loads}
    want = {u: sorted({f"{w}2" for w in html.split() if w < "g"}) for u, html in newest.items()}
    assert results(r) == want
