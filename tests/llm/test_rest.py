"""Mixing, secrets, packing, URLs, licences, languages and neighbours."""

import base64
import bz2
import gzip
import lzma
import math
import random
import re
import tracemalloc
import urllib.parse
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from . import brute
from crawlaudit.llm import language, licences, mixing, neighbours, pack, secret_scan, urls
from crawlaudit.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "embeddings"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    have = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=brute.key)
    assert have == sorted(cur.fetchall(), key=brute.key)


# ------------------------------------------------------------------ mixing


def leaf_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, epoch long, draw string, tokens long, h string")


def mixed(spark, rows, fraction, epochs):
    weights = {"domain": F.when(F.col("domain") == "a", 3).otherwise(1), "lang": F.lit(1), "source": F.lit(1)}
    docs = leaf_rows(spark, [(*r, None, None, None, None) for r in rows])
    return mixing.mix(docs, mixing.LEVELS, weights, fraction, epochs, 5, mixing.words(F.col("text"))).collect()


def test_shortage_goes_to_siblings_first(spark):
    text = " ".join(["w"] * 10)
    # Domain a is due 3/4 of 100 tokens; its language x has 10 only, so y takes what x cannot.
    rows = [(i, text, "a", "x" if i == 0 else "y", "s") for i in range(10)] + [(100 + i, text, "b", None, "s") for i in range(10)]
    taken = {}
    for r in mixed(spark, rows, 0.5, 1):
        taken[r.domain, r.lang] = taken.get((r.domain, r.lang), 0) + r.taken
    assert taken == {("a", "x"): 10, ("a", "y"): 65, ("b", None): 25}


def test_whole_epochs_then_a_prefix(spark):
    rows = [(i, " ".join(["w"] * 7), "a", "x", "s") for i in range(5)] + [(9, "", "a", "x", "s"), (8, None, "a", "x", "s"), (7, " ".join(["w"] * 365), "b", "x", "s")]
    got = [r for r in mixed(spark, rows, 0.2, 3) if r.domain == "a"]
    assert sum(r.taken for r in got) == 60
    assert sorted(r.doc_id for r in got if r.epoch == 1) == [0, 1, 2, 3, 4]
    assert sum(r.taken for r in got if r.epoch == 2) == 25 and all(r.taken == 7 or r.taken == 4 for r in got)
    assert [tuple(r) for r in mixed(spark, rows, 0.2, 3)] and mixed(spark, [], 0.5, 2) == []


# ------------------------------------------------------------------ secrets


def test_base_spans():
    cases = {
        'x PassWord = "abcdef" y': ["assign:2:20"], "token:abcde": [], "secret=token:abcdefgh": [], "api-key=abcdefg": [], "API_KEY: abcdefg": ["assign:0:16"],
        "AKIA" + "A" * 16: ["access:0:20"], "AKIA" + "A" * 15: [], "a" * 24: ["hex:0:24"], "ü" + "0" * 23: [], "ü" + "0" * 30: ["hex:1:31"], "": [],
        "\u017fecret=abcdefgh": [], "to\u212aen=abcdefgh": [],
    }
    for text, spans in cases.items():
        assert [f"{k}:{a}:{b}" for a, b, k in sorted(secret_scan.base_spans(text))] == spans, text


WRAP = {
    "percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()), "quote": lambda s: urllib.parse.quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "entities": lambda s: "".join(f"&#x{ord(c):x};" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(), "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), "gzip": lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
}


@pytest.mark.parametrize("outer", WRAP)
@pytest.mark.parametrize("inner", WRAP)
def test_nested_layers_are_unwrapped(outer, inner):
    wrapped = WRAP[outer](WRAP[inner]('password = "hunter22secret"'))
    text = f"Ünd before {wrapped} after"
    spans = secret_scan.scan(text)
    assert [k for _, _, k in spans] == ["assign"]
    assert 11 <= spans[0][0] < spans[0][1] <= 11 + len(wrapped)


def test_spans_stay_on_the_piece_that_holds_the_secret():
    text = "a%20b token%3Dabcdefgh c"
    assert [text[a:b] for a, b, _ in secret_scan.scan(text)] == ["token%3Dabcdefgh"]
    assert secret_scan.scan("%2525252525" * 50) == []
    long = "x " * 200_000 + WRAP["zlib"]("y " * 3_000_000 + "token=abcdefghij")
    assert [k for _, _, k in secret_scan.scan(long)] == ["assign"]


def test_urlsafe_base64_is_read_whole():
    encode = lambda data: base64.urlsafe_b64encode(data).decode()
    for secret in ("\u00ff\u00fe~~~ok password = hunter22secret", "the key is ~~~ok \u00ff?> password = hunter22secret", "password = hunter22secret and \u00ff\u00fe?>~~"):
        run = encode(secret.encode())
        assert "-" in run or "_" in run
        assert [k for _, _, k in secret_scan.scan(f"before {run} after")] == ["assign"], secret
    rng, places = random.Random(12), set()
    for _ in range(300):
        run = encode(zlib.compress(f"{rng.randbytes(30).decode('latin-1')} {rng.random()} token=abcdefgh{rng.random()}".encode()))
        at = min((run.find(c) for c in "-_" if c in run), default=None)
        places.add(None if at is None else at < 12)
        spans = secret_scan.scan(f"before {run} after")
        assert [k for _, _, k in spans] == ["assign"] and spans[0][0] == 7, run
    assert {True, False} <= places


def wrapped(data, width=76, end="\n"):
    run = base64.b64encode(data).decode()
    return end.join(run[i : i + width] for i in range(0, len(run), width))


NOISE = random.Random(13).randbytes(400).hex(" ")
STREAMS = {
    "members": lambda s: gzip.compress(NOISE.encode(), mtime=0) + gzip.compress(s, mtime=0), "unused": lambda s: zlib.compress(NOISE.encode()) + b" " + s, "bz2": bz2.compress, "xz": lzma.compress,
    "lzma": lambda s: lzma.compress(s, lzma.FORMAT_ALONE), "frames": lambda s: zstandard.compress(NOISE.encode()) + b"\x51\x2a\x4d\x18\x02\0\0\0ab" + zstandard.compress(s), "padded": lambda s: bz2.compress(b"x") + b"\0\0" + zlib.compress(s),
}


@pytest.mark.parametrize("tool", STREAMS)
def test_streams_are_read_to_their_end(tool):
    data = STREAMS[tool](b'password = "hunter22secret"')
    for run in (base64.b64encode(data).decode(), wrapped(data), wrapped(data, 50, "\r\n  "), "".join(f"%{b:02X}" for b in data), repr(data), urllib.parse.quote(data, safe="")):
        text = f"Ünd before: {run} after"
        spans = secret_scan.scan(text)
        assert spans and {k for _, _, k in spans} == {"assign"}, run
        assert all(12 <= a < b <= 12 + len(run) for a, b, _ in spans), run


def test_pieces_with_other_characters():
    for secret in ("token=abcdefgh 12\u00a0345", "a\u00adb token=abcdefgh", "\u200btoken=abcdefgh\0", "\ufefftoken=abcdefgh"):
        assert [k for _, _, k in secret_scan.scan("see " + WRAP["base64"](secret))] == ["assign"], secret
    for data in (b"\xff\x01 token=abcdefgh \x80", *("Łódź token=abcdefgh Ł".encode(c) for c in ("utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-be"))):
        for run in (base64.b64encode(data).decode(), base64.b64encode(zlib.compress(data)).decode()):
            assert [k for _, _, k in secret_scan.scan("see " + run)] == ["assign"], data
    data = "é token=abcdefgh é".encode("utf-16-le")
    (a, b, _), = secret_scan.scan("see " + base64.b64encode(data).decode())
    assert (a, b) == (4 + 4 * 4 // 3, 4 + (32 * 4 + 2) // 3)


def test_wrapped_base64_is_one_piece():
    for before in (40, 50, 54):
        run = wrapped(b"x " * (before // 2) + b"token=abcdefghijklmnop rest " + b"y " * 60)
        for text in (run, "see\n" + run + "\nend", run.replace("\n", "\r\n"), run.replace("\n", "\\n")):
            at, gap = text.index("eCB4"), text.count("\r") and 2 or text.count("\\n") and 2 or 1
            place = lambda i: at + i + i // 76 * gap
            want = place(before * 4 // 3), place(((before + 22) * 4 + 2) // 3 - 1) + 1, "assign"
            assert want in secret_scan.scan(text), text
    text = wrapped(zlib.compress(" ".join(NOISE.split()[::-1]).encode() + b" token=abcdefghij"))
    assert secret_scan.scan(f"see\n{text}\nend") == [(4, 4 + len(text.rstrip("=")), "assign")]


def test_large_streams_are_cut_outside_of_runs(monkeypatch):
    monkeypatch.setattr(secret_scan, "LAYER_CHARS", 40_000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1_000)
    inner = base64.b64encode(zlib.compress(random.Random(14).randbytes(9_000).hex(" ").encode() + b" token=abcdefghij")).decode()
    assert len(inner) > 10_000
    for at in (25_000, 30_000, 35_001, 38_002, 39_999):
        text = base64.b64encode(gzip.compress(("x " * 40_000)[:at].encode() + b" " + inner.encode() + b" y" * 30_000, mtime=0)).decode()
        assert [k for _, _, k in secret_scan.scan(text)] == ["assign"], at


def test_jumps_show_what_level_after_level_shows(monkeypatch):
    rng = random.Random(21)
    units = [("%", "25"), ("&", "#38;"), ("&", "#x26;"), ("\\", "x5c"), ("\\", "u005c"), ("\\", "U0000005C")]
    ends = ["41", "3d", "#65;", "x41", "25token=abcdefgh", "41" * 15, "25" + base64.b64encode(b"say token=abcdefgh").decode()]
    texts = []
    for _ in range(300):
        deep = ["".join((opener := rng.choice(units))[:1]) + opener[1] * rng.randint(0, 30) + rng.choice(ends) for _ in range(rng.randint(1, 3))]
        texts.append(rng.choice(["", "token=", "x ", "%41 "]) + rng.choice([" ", "", "ab"]).join(deep) + rng.choice(["", " password: zzzzzz", "%61"]))
    jumped = [secret_scan.scan(t) for t in texts]
    monkeypatch.setattr(secret_scan, "STEADY", 10**9)
    assert jumped == [secret_scan.scan(t) for t in texts]


def test_very_deep_nesting():
    deep = 100_000
    tracemalloc.start()
    spans = secret_scan.scan("%" + "25" * deep + "41 token=abcdefgh")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Each level's digits, as long as there are 24 of them, begin one unit later.
    end = 2 * deep + 3
    assert spans == [(1 + 2 * k, end, "hex") for k in range(deep - 10)] + [(end + 1, end + 15, "assign")]
    assert peak < 300 << 20
    assert secret_scan.scan("&" + "#38;" * deep + "#65; token=abcdefgh") == [(4 * deep + 6, 4 * deep + 20, "assign")]


def test_secret_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "token=abcdefgh", None), (3, "token=abcdefgh", "x"), (3, "token=abcdefgh", "x")]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_assign, r.spans) for r in got if r.doc_id) == [(False, 1, 0, ""), (False, 2, 0, ""), (False, 3, 1, "assign:0:14"), (False, 3, 1, "assign:0:14")]
    assert secret_scan.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ packing


def reference_ids(text):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(pack.public_path("byte_bpe_50k.json"))
    return [*tool.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_reference_tokenizer():
    encode = pack.Encoder()
    for text in ["", " ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "don't  stop\n\n now", "Ünï 12 x<|endoftext|>y", "\u00a0x \u2003 y", "日本 語", "a" * 3000, "x " * 50]:
        for _ in range(2):
            assert np.frombuffer(encode(text), "<u4").tolist() == reference_ids(text)[:-1], text


def test_packing_is_a_partition_of_all_ids(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randint(0, 9999)) for _ in range(rng.choice([0, 1, 30, 400, 900, 1500, 6000])))) for i in range(120)] + [(500, None), (501, "")]
    got = pack.pack_documents(spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, start long, part int").repartition(3), block_tokens=50_000).toPandas()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = int(s.length.sum())
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        assert total == 2048 or total & (total - 1) == 0
    assert (got.groupby("sequence_id").length.sum() < 2048).sum() <= 3 * 11
    for doc_id, text in rows:
        ids, at = np.array(reference_ids(text), "<u4"), 0
        for p in got[got.doc_id == doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert pack.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_takes_no_more_than_there_is():
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 2048, 5000)
    histogram = np.bincount(lengths, minlength=2049)
    used = np.zeros(2049, int)
    for combo, n in pack.plan(histogram):
        assert sum(combo) == 2048 and n > 0
        for v in combo:
            used[v] += n
    assert (used <= histogram).all() and used.sum() > 0.7 * len(lengths)


# ------------------------------------------------------------------ URLs


def test_url_rules(spark):
    cases = {
        "https://a.Example.COM/en/76?x": ("a.example.com", "/en/76", "example.com/en/7", "allow"), "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "x://h.net/de/": ("h.net", "/de/", "net/de/", "allow"),
        "x://h.example.net/de/8": ("h.example.net", "/de/8", "example.net/de/8", "block"), "http://a.org?u=http://b/es/": ("a.org", "", None, "allow"),
        "no host": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://com:80/en/": ("com:80", "/en/", None, "allow"), "http://a.org#/es/": ("a.org", "", None, "allow"),
    }
    rows = [(i, u, "f", 0) for i, u in enumerate(cases)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, f string, score int"), loss=0.0).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {i: c[:3] for i, c in enumerate(cases.values())}
    assert all(r.verdict == list(cases.values())[r.page_id][3] for r in got if r.rule)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_follows_its_labels(spark):
    rows = [(i, f"http://shop{i}.com/en/x") for i in range(50)] + [(100 + i, f"http://news{i}.net/de/{'fr/' * (i % 3)}x") for i in range(50)]
    rows += [(200, "http://shop7.com/fr/en/x"), (201, "http://news7.net/de7/fr/x"), (200, "http://shop7.com/fr/en/x")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 200").collect()}
    assert got[200].verdict == "block" and got[200].score < 0 < got[201].score


# ------------------------------------------------------------------ licences


def test_licence_units(spark):
    mit = licences.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ;")), (2, "words\nReleased under the MIT Licence\nwords"), (3, "intro\n\n" + mit + "\n\nend"),
        (4, "Licensed under the Apache License 2.0 and more"), (5, None), (6, ""), (7, "Licensed under GNU GPL v3."), (7, "Licensed under GNU GPL v3."), (None, "Released under the MIT License.\n" * 2),
    ]
    got = sorted(map(tuple, licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=brute.key)
    want = [(1, "MIT", 0, "MIT"), (2, None, 1, "MIT"), (3, None, 0, "MIT"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (7, "GPL-3.0", 1, "GPL-3.0"), (7, "GPL-3.0", 1, "GPL-3.0"), (None, None, 2, "MIT")]
    assert got == sorted(want, key=brute.key)
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_licence_files(spark):
    def cut(text):
        return re.sub(r"(following conditions(?: are met)?:|Software\.|granted, provided.*?copies\.|disclaimer\.|distribution\.|permission\.) ", r"\1\n\n", re.sub(r"\s+", " ", text))

    rows, want = [], {}
    for licence, (body, titles) in licences.TITLED.items():
        layout = cut(body)
        assert "\n\n" in layout
        for text in (f"{titles[0]}\n\nCopyright (c) 2021 Some One\n\n{layout}\n", f"Copyright (c) 2021, Some One\nAll rights reserved.\n\n{layout}"):
            rows.append((len(rows), text))
            want[rows[-1][0]] = (licence, licence)
        rows.append((len(rows), f"A readme.\n\n# Licence\n\nCopyright 2020 X\n\n{layout}\n\nThanks.\n\nBye"))
        want[rows[-1][0]] = (None, licence)
        rows.append((len(rows), f"A readme.\n\n{layout[:-40]}\n\nThanks."))
        want[rows[-1][0]] = (None, "")
    for licence in licences.FILES:
        text = next(t for name, t in licences.full_texts() if name == licence)
        rows += [(len(rows), text), (len(rows) + 1, f"Intro\n\n{text}\n\nend"), (len(rows) + 2, text.split("\n\n", 1)[1])]
        for (i, _), name in zip(rows[-3:], (licence, None, licence)):
            want[i] = (name, licence)
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (w[0], w[1]) for i, w in want.items()} == {i: (g[0], ",".join(n for n in g[1].split(",") if n == want[i][1])) for i, g in got.items()}


# ------------------------------------------------------------------ languages


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.96


def test_language_edges(spark):
    rows = [(i, " ".join(["the and of is"] * 9), "en", 1) for i in range(20)] + [(100 + i, " ".join(["der und die das"] * 9), "de", 1) for i in range(20)]
    rows += [(200, None, "en", 1), (201, "", "en", 1), (202, "12 34 !!", "en", 1), (203, "the and of is the and of is the and", None, 1), (None, "der und die das der und die", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and [got[i].score for i in (200, 201, 202)] == [0.0] * 3
    assert got[203].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    kept = language.known_language(docs)
    assert kept.columns == docs.columns and {200, 201, 202}.isdisjoint(r.doc_id for r in kept.collect())
    assert language.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ------------------------------------------------------------------ neighbours


def exact_nearest(rows, every=50, top=5):
    """By exact fractions: (query, rank, vec) and the cosine of doubles scaled by powers of two."""
    fit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            e = math.frexp(max(map(abs, v)))[1]
            fit[i, tuple(v)] = np.ldexp(np.array(v, float), -e)
    out = {}
    for (q, qv), a in fit.items():
        if q % every == 0:
            scored = [(-float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i) for (i, v), b in fit.items() if i != q and len(v) == len(qv)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:top]]
    return out


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_every_leaf_visited_is_exact(spark):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [1.0, 2.0] + [0.0] * 6) for i in range(60)]
    rows += [(None, [1.0] * 8), (400, None), (450, [0.0] * 8), (500, [float("nan")] + [1.0] * 7), (550, [None] + [1.0] * 7), (600, [float("inf")] + [1.0] * 7), (0, rows[0][1])]
    rows += [(700, [3e200] + [1e200] * 7), (701, [3e-200] + [1e-200] * 7), (702, [1e308, -1e308] + [0.0] * 6), (750, [5e-324] + [0.0] * 7)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string").repartition(3)
    got = found_nearest(neighbours.nearest(table, table.where("vec_id % 50 = 0"), "vec_id", "embedding", visit=4.0, part_rows=40))
    want = exact_nearest(rows)
    assert {q: [i for i, _ in of] for q, of in got.items()} == {q: [i for i, _ in of] for q, of in want.items()}
    assert all(abs(a[1] - b[1]) <= 1e-15 for q in want for a, b in zip(got[q], want[q]))
    # Ties of equal vectors go to the smaller ids, and extremes meet what points their way.
    assert [i for i, _ in got[300]] == [301, 302, 303, 304, 305] and got[700][0] == (701, 1.0)


def test_lengths_do_not_mix(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5 if i % 3 else 9)]) for i in range(200)] + [(1000, [1.0]), (1050, [2.0, 1.0]), (1051, [1.0, 1.0]), (1001, [-3.0])]
    rows = [(0, [1.0, 1.0, 1.0]), *rows[1:]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sample in (20_000, 20):  # a small sample knows only some lengths
        got = found_nearest(neighbours.nearest(table, table.where("vec_id % 50 = 0"), "vec_id", "embedding", visit=4.0, sample_rows=sample, part_rows=7))
        assert {q: [i for i, _ in of] for q, of in got.items()} == {q: [i for i, _ in of] for q, of in exact_nearest(rows).items() if of}


def recall(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = found_nearest(neighbours.nearest(table, table.where("vec_id % 50 = 0"), "vec_id", "embedding", **options))
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q, of in got.items():
        score = np.where(ids == q, -2.0, unit @ unit[ids == q][0])
        bar = np.sort(score)[-5]
        hit += sum(s >= bar - 1e-12 for _, s in of)
        assert len(of) == 5
    return hit / (5 * len(got))


def test_recall_on_the_given_vectors(spark):
    for sf in ("0.01", "0.1"):
        rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
        assert recall(spark, rows) >= 0.9


def test_recall_with_a_hot_vector(spark):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(20_000, 24))
    v[::3] = v[0]  # a third of all rows
    assert recall(spark, [(i, x.tolist()) for i, x in enumerate(v) if i % 50 or i < 3000], part_rows=2000) >= 0.9


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_of_every(empty).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest_of_every(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline
    from crawlaudit.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "123", "en", "src1", 3)], docs.schema)
    docs = docs.union(extra)
    results = []
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF))
        results.append(docs)
    known, distinct, far, mixed_, packed = results
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert known.columns == distinct.columns == far.columns == mixed_.columns
    assert {9001, 9002, 9003}.isdisjoint(i for i, _ in rows(known)) and known.count() >= 195
    assert {i for i, _ in rows(distinct)} == {keep for _, keep, _, _ in brute.exact(rows(known))}
    assert {i for i, _ in rows(far)} == brute.one_of_each(rows(distinct))
    supply = {}
    for r in far.collect():
        supply[r.doc_id] = len(brute.words(r.text))
    took = sum(supply[i] for i, _ in rows(mixed_))
    assert 0.75 * sum(supply.values()) <= took <= 0.8 * sum(supply.values()) + 80 * max(supply.values())
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows(mixed_)}
    assert packed.agg(F.sum("length")).first()[0] == sum(len(reference_ids(t)) for _, t in rows(mixed_))
