"""Golden cases of the column functions."""

import random

from pyspark.sql import functions as F

from crawlaudit.functions import directives as D, html as H, text as T, urls as U, versions as V
from crawlaudit.operators import page as A, robots as R, trackers as TR


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_lengths_and_entities(spark):
    rows = [(None,), ("",), ("é" * 29,), ("é" * 30,), ("x" * 61,)]
    got = values(spark, rows, "s string", T.length_status(F.col("s"), T.TITLE_RANGE))
    assert [g[0] for g in got] == ["missing", "missing", "short", "good", "long"]
    got = values(spark, [("a &amp; b&eacute;&#233;&#x1F600;&nope; &copy x&",)], "s string", T.decode_entities(F.col("s")))
    assert got[0][0] == "a & béé😀&nope; © x&"


def test_phrase_and_clip(spark):
    long = " ".join(f"w{i}" for i in range(40))
    got = values(spark, [("“a”  «b» c",), (long,), (" ",)], "s string", T.exact_phrase(F.col("s")), T.clip(F.col("s"), 10))
    assert got[0] == ("a b c", "“a” «b» c")
    assert len(got[1][0].split()) == 32 and got[1][1] == "w0 w1 w2 …"
    assert got[2] == ("", "")


def test_attributes_survive_hostile_markup(spark):
    tag = """<a title="x href='no'" data-href=bad HREF='/y?a=1&amp;b=2' disabled href="second">"""
    t = F.col("t")
    got = values(spark, [(tag,)], "t string", H.attr(t, "href"), H.attr(t, "disabled"), H.attr(t, "rel"), H.attributes(t))
    assert got[0][:3] == ("/y?a=1&b=2", "", None)
    assert got[0][3]["href"] == "/y?a=1&b=2" and got[0][3]["title"] == "x href='no'"


def test_urls(spark):
    base = U.base_parts(U.normalize(F.lit("https://Ex.com/a/b.html?q#f")))
    cases = {
        "/x/../y": "https://ex.com/y", "c d": "https://ex.com/a/c%20d", "//o.org": "https://o.org/", "?z": "https://ex.com/a/b.html?z",
        "#t": "https://ex.com/a/b.html?q#t", "": "https://ex.com/a/b.html?q", "../../../r": "https://ex.com/r", "./": "https://ex.com/a/",
        "mailto:x@y.z": "mailto:x@y.z", "http://H.com:80": "http://h.com/", "/é": "https://ex.com/%C3%A9", "http://": "http://",
    }
    got = values(spark, [(k,) for k in cases], "r string", F.col("r"), U.resolve(F.col("r"), base))
    assert dict(got) == cases
    assert values(spark, [("https://www.google.co.uk/search?q=1",), ("https://google.example.com/search",), ("https://www.google.fr/maps",)], "u string", U.is_serp(F.col("u"))) == [(True,), (False,), (False,)]


def test_directives(spark):
    v = "noindex, googlebot: nofollow, max-image-preview: large, otherbot: none"
    got = values(spark, [(v,), (None,)], "v string", D.directives_for(F.col("v")), D.directives_chip(D.directives_for(F.col("v"))))
    assert got == [(["noindex", "nofollow", "max-image-preview: large"], "noindex"), ([], "index, follow")]
    link = D.parse_link_header(F.lit('<https://a/?x=1,2>; rel="alternate"; hreflang="fr", </b>; rel=preload'))
    assert [tuple(x) for x in spark.range(1).select(link).first()[0]] == [("https://a/?x=1,2", "alternate", "fr"), ("/b", "preload", None)]


def test_versions_order(spark):
    ordered = ["1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0+build", "1.0.1", "1.10"]
    pairs = [(a, b, (i > j) - (i < j)) for i, a in enumerate(ordered) for j, b in enumerate(ordered)]
    got = values(spark, pairs, "a string, b string, c int", F.col("c"), V.compare_versions(F.col("a"), F.col("b")))
    assert all(want == have for want, have in got)
    assert values(spark, [("1", "1.0.0"), ("x", "2")], "a string, b string", V.compare_versions(F.col("a"), F.col("b"))) == [(0,), (0,)]


def test_core_and_latest_status(spark):
    offers = F.array(*map(F.lit, ["7.1.3", "6.9.10", "6.8.7"]))
    got = values(spark, [("7.1.3",), ("7.2",), ("6.9.10",), ("6.9.4",), ("5.0",), ("?",)], "v string", V.core_status(F.col("v"), offers)["status"])
    assert [g[0] for g in got] == ["latest", "latest", "patched", "update", "unsupported", None]
    got = values(spark, [("1.0", "2.0"), ("2.0-rc.1", "1.9"), ("2.0", "2.0"), ("2.0-rc.1", "2.0")], "a string, b string", V.latest_status(F.col("a"), F.col("b"))["status"])
    assert [g[0] for g in got] == ["behind", "prerelease", "latest", "behind"]


def test_rule_patterns(spark):
    cases = [("/fish", "/fish/salmon", True), ("/fish$", "/fish/", False), ("/*.php$", "/a.php", True), ("/*.php$", "/a.php?x", False), ("/a.b", "/axb", False), ("/é", "/%C3%A9t", True)]
    got = values(spark, cases, "p string, u string, w boolean", F.col("w"), R.matches_rule(F.col("p"), F.col("u")))
    assert all(a == b for a, b in got)


def test_hreflang_codes(spark):
    codes = {"fr": True, "en-GB": True, "zh-Hant-TW": True, "es-419": True, "X-Default": True, "en_GB": False, "english": False}
    assert dict(values(spark, [(k,) for k in codes], "c string", F.col("c"), A.valid_hreflang(F.col("c")))) == codes


def test_placeholder_ids(spark):
    cases = {"G-ABC1234": True, "G-XXXXXXX": False, "G-0000000": False, "G-1234567": False, "G-abc1234": False}
    assert dict(values(spark, [(k,) for k in cases], "i string", F.col("i"), TR.valid_id(F.col("i"), F.lit("G-[A-Z0-9]{6,12}"), ["G-[A-Z0-9]{6,12}"]))) == cases


def test_international_hosts(spark):
    rng = random.Random(3)
    labels = ["bücher", "münchen", "пример", "straße", "a-ü", "日本語テスト", "😀", "ab😀cd😀é", "mañana"] + ["".join(rng.choice("abc-1éüñßжд例語😀") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    labels = [x for x in labels if not x.isascii()]
    got = values(spark, [(x,) for x in labels], "s string", U.punycode(F.col("s")))
    assert [g[0] for g in got] == [x.encode("punycode").decode() for x in labels]
    got = values(spark, [("https:\\\\Bücher.Example\\a?x=\\",), ("HTTP://пример。рф",)], "s string", U.normalize(F.col("s")))
    assert [g[0] for g in got] == ["https://xn--bcher-kva.example/a?x=\\", "http://xn--e1afmkfd.xn--p1ai/"]
