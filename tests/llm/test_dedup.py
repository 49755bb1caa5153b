"""Repeated passages, near and exact copies against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from crawlaudit.llm import exact, simhash, substring

CLASHING = "doc_id long, text string, h long, row long, fp long, doc string, spans string, root long, bytes string, absent int, d string, norm string"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def passages(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.3:
                parts += [rng.choice("ab")] * rng.randint(5, 60)
            elif kind < 0.6:
                parts += list("xyz"[: rng.randint(2, 3)]) * rng.randint(3, 25)
            elif kind < 0.8:
                story = random.Random(rng.randint(0, 9))
                at = rng.randint(0, 60)
                parts += [str(story.randint(0, 99)) for _ in range(200)][at : at + rng.randint(10, 90)]
            else:
                parts += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        blank = rng.choice([" ", "\n", "\t \x0b"])
        rows.append((rng.choice([None, i, i, i // 2]), None if rng.random() < 0.05 else blank.join(parts)))
    return rows + rows[:5]


@pytest.mark.parametrize("window, seed", [(50, 1), (20, 2), (7, 3)])
def test_repeated_passages(spark, window, seed):
    rows = passages(seed)
    got = substring.remove_repeats(table(spark, rows), window=window, low_rounds=8 if window == 50 else 3).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=brute.key) == brute.repeats(rows, window)


def test_repeated_passage_in_a_very_long_text(spark):
    rng = random.Random(4)
    long = [str(rng.random()) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, "start " + " ".join(long[40_000:40_060]) + " end"), (3, "")]
    got = substring.remove_repeats(table(spark, rows)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=brute.key) == brute.repeats(rows, 50)


def test_texts_of_one_id_are_told_apart(spark):
    # Two texts with one 32-bit hash, and many texts without an id.
    seen, pair = {}, None
    candidates = [(i, " ".join(f"w{i}x{k}" for k in range(55))) for i in range(150_000)]
    for r in spark.createDataFrame(candidates, "i long, text string").select("i", F.hash("text").alias("h")).collect():
        if r.h in seen:
            pair = seen[r.h], r.i
            break
        seen[r.h] = r.i
    x, y = (candidates[i][1] for i in pair)
    rows = [(1, x), (5, x), (5, y), (None, x), (None, y), (None, "z " + y), (None, None), (None, "")]
    got = substring.remove_repeats(table(spark, rows)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=brute.key) == brute.repeats(rows, 50)
    assert [r.n_removed for r in got if r.doc_id == 5 and r.n_words == 55].count(0) == 1


def test_regular_sequences_have_different_fingerprints():
    bits = "".join(str(bin(i).count("1") % 2) for i in range(4096))
    words = substring.Words([" ".join("ab"[int(c)] for c in bits[:n]).encode() for n in (1024, 4096)] + [" ".join("ba"[int(c)] for c in bits[:1024]).encode()])
    start, end = np.array([0, 1024, 5120]), np.array([1024, 2048, 6144])
    a, b, c = words.fingerprint(start, end).tolist()
    assert a == b != c and words.check(start, end).tolist()[0] != words.check(start, end).tolist()[2]
    low, (s, e) = substring.parse(words)
    of = {}
    for x, y, k in zip(s.tolist(), e.tolist(), words.fingerprint(s, e).tolist()):
        assert of.setdefault(k, words.hash[x:y].tobytes()) == words.hash[x:y].tobytes()


def texts(seed, n=200):
    rng = random.Random(seed)
    stories = [[rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(200)] for _ in range(5)]
    rows = []
    for i in range(n):
        w = list(rng.choice(stories))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = "changed" + str(rng.randint(0, 99))
        rows.append((rng.choice([None, i, i, i // 2]), rng.choice([None, "", " \n", "A b", "a B", "one  two\tthree"]) if rng.random() < 0.1 else " ".join(w)))
    return rows + rows[:5]


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_near_duplicates(spark, monkeypatch, shard_rows):
    rows = texts(5)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.RADIUS, simhash.BLOCKS, shard_rows))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=brute.key) == brute.near(rows)


def test_one_of_each_group_of_similar_texts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(250):
        story = random.Random(rng.randint(0, 20))
        w = [str(story.randint(0, 500)) for _ in range(story.choice([0, 3, 40, 80, 120]))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 999))
        rows.append((i, " ".join(w)))
    got = {r.doc_id for r in simhash.one_of_each(table(spark, rows)).collect()}
    assert got == brute.one_of_each(rows) and len(got) > 30


def test_repeated_passages_do_not_set_texts_apart(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):
        w = [str(rng.randint(0, 9999)) for _ in range(300)]
        at = rng.randint(0, 270)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: at + 30] + w[at : at + 30] * 30 + w[at + 30 :]))]
    got = {r.doc_id for r in simhash.one_of_each(table(spark, rows)).collect()}
    assert got == brute.one_of_each(rows) == {2 * i for i in range(60)}


def test_tree_search_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 16, 300, dtype=np.uint64)
    fp = np.unique(fp)
    tree = rng.integers(0, 3, len(fp))
    found = {(q, n) for part in simhash.Forest(tree, fp).search(fp, tree, 3) for q, n in zip(*map(np.ndarray.tolist, part))}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if tree[i] == tree[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize("collide", [False, True])
def test_exact_copies(spark, collide):
    rows = texts(7) + [(None, "alone"), (900, "x \n y"), (901, "x y"), (902, "x  y "), (903, None), (904, "")]
    collisions = F.pmod(F.xxhash64("norm"), F.lit(3)) if collide else None
    got = exact.exact_duplicates(table(spark, rows), key=collisions, bucket_keys=4).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=brute.key) == brute.exact(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    entries = exact.directory(keys, bucket_keys=100)
    at = keys.join(entries, F.shiftrightunsigned("h", 64 - exact.DEPTH) == F.col("entry"))
    sizes = {r["bucket"]: r["count"] for r in at.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 100 and len(sizes) > 30


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], CLASHING)
    rows = spark.createDataFrame([(1, "a b c d", *[None] * 10), (2, "a b  c d", *[None] * 10)], CLASHING)
    for run, n in ((substring.remove_repeats, 2), (simhash.near_duplicates, 2), (exact.exact_duplicates, 2), (exact.without_copies, 1), (simhash.one_of_each, 1)):
        assert run(empty).count() == 0
        assert run(rows).count() == n
    assert exact.without_copies(rows).columns == rows.columns and simhash.one_of_each(rows).columns == rows.columns
