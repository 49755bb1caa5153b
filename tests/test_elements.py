"""The element tree and microdata against plain stacks."""

import json
import random

from pyspark.sql import functions as F

from crawlaudit.operators import elements as EL, structured as SD

BLOCK = ["div", "ul", "section"]


def grown(rng, depth, out, around):
    """Random markup, written with or without the end tags that may be left out; ``out`` gets (id, ids around it)."""
    html = ""
    for _ in range(rng.randint(0, 3)):
        kind = rng.choice(["div", "ul", "span", "br", "text", "stray"])
        if kind == "text":
            html += rng.choice(["x ", "y &amp; ", "<!-- <div id=no> -->"])
        elif kind == "stray":
            html += "</em>"
        elif kind == "br":
            out[len(out)] = list(around)
            html += f'<br id={len(out) - 1}>'
        elif kind == "ul" and depth:
            me = len(out)
            out[me] = list(around)
            html += f"<ul id={me}>"
            for _ in range(rng.randint(1, 3)):
                item = len(out)
                out[item] = [*around, me]
                html += f"<li id={item}>" + grown(rng, depth - 1, out, [*around, me, item]) + rng.choice(["", "</li>"])
            html += "</ul>"
        elif depth:
            me = len(out)
            out[me] = list(around)
            html += f"<{kind} id={me}>" + grown(rng, depth - 1, out, [*around, me]) + f"</{kind}>"
    return html


def test_containment(spark):
    rng = random.Random(4)
    pages, want = [], {}
    for p in range(60):
        want[p] = {}
        pages.append((p, "http://a.example/", grown(rng, 4, want[p], [])))
    rows = EL.elements(EL.markup(spark.createDataFrame(pages, "page_id long, url string, html string")))
    got = {}
    for r in rows.select("page_id", "start", "end", F.regexp_extract("tag", r"id=(\d+)", 1).cast("int").alias("id")).collect():
        got.setdefault(r.page_id, []).append((r.id, r.start, r.end))
    for p, of in want.items():
        have = {i: sorted(j for j, s, e in got.get(p, []) if s < start < e) for i, start, _ in got.get(p, [])}
        assert have == {i: sorted(around) for i, around in of.items()}, pages[p]


def test_owner_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    rows = EL.elements(EL.markup(empty))
    assert rows.count() == 0 and EL.owned(rows, F.lit(True)).count() == 0 and EL.select_within(rows, F.lit(True), F.lit(True)).count() == 0


def test_microdata_items(spark):
    html = """<div itemscope itemtype="https://schema.org/A  https://schema.org/B" itemid="u:1"><b itemprop="n m">N <i>x</i> &amp; y</b>
      <p itemprop=d>one<p itemprop=d>two<div itemprop="in" itemscope itemtype=T><meta itemprop=c content="5"><a itemprop=url href="/x?a=1&amp;b">t</a>
      <div itemprop=deep itemscope><time itemprop=t datetime=2020>now</time><data itemprop=v value=7>seven</data><img itemprop=i src=p.png></div></div>
      <div itemscope><span itemprop=own>root inside</span></div></div>
      <div itemprop=orphan itemscope><span itemprop=lost>no</span><div itemscope><span itemprop=kept>yes</span></div></div><span itemprop=alone>no</span>"""
    pages = spark.createDataFrame([(1, "http://a.example/d/e", html), (2, "http://a.example/", "<p itemprop=x>none"), (3, "http://a.example/", None)], "page_id long, url string, html string")
    rows = SD.microdata(pages)
    plain = [(r.parent, r.prop, r.value) for r in rows.where("item is null").orderBy("ord").collect()]
    assert plain == [(0, "n", "N x & y"), (0, "m", "N x & y"), (0, "d", "one"), (0, "d", "two"), (1, "c", "5"), (1, "url", "http://a.example/x?a=1&b"),
                     (2, "t", "2020"), (2, "v", "7"), (2, "i", "http://a.example/d/p.png"), (3, "own", "root inside"), (4, "kept", "yes")]
    objects = {r.item: json.loads(r.json) for r in SD.microdata_objects(rows).collect()}
    assert objects[0] == {"@type": "A, B", "@id": "u:1", "n": "N x & y", "m": "N x & y", "d": ["one", "two"], "in": {
        "@type": "T", "c": "5", "url": "http://a.example/x?a=1&b", "deep": {"@type": "Untyped item", "t": "2020", "v": "7", "i": "http://a.example/d/p.png"}}}
    assert objects[3] == {"@type": "Untyped item", "own": "root inside"} and objects[4]["kept"] == "yes" and len(objects) == 3
