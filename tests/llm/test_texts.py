"""Operators 11 to 13 against plain versions: divergence of sources, edit fingerprints, fill-in-middle."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crawlaudit.llm import divergence, editprint, infill

DOCS = "doc_id long, text string, lang string, source string, n long, rank int, part int"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns of clashing names."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)


def word_rows(n=400, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "delta", "don't", "x1y", "Ünïcode", "ZED", "a", "naïve-ish"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", None])
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 12))), lang, source))
    return rows + [(1000, None, "en", "s9"), (1001, "", "fr", "s1"), (1002, "unique words", "fr", "s2"), (None, "alpha alpha", "en", "s0"), (5, "beta " * 3000, "de", "s1")]


# ---- divergence of sources


def terms(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold)


def divergences(rows, least=10, top=10):
    docs = [((lang or "", source or ""), Counter(terms(text))) for _, text, lang, source in rows]
    groups = sorted({g for g, _ in docs})
    out = []
    for lang in sorted({g[0] for g in groups}):
        in_docs = Counter(t for (l, _), c in docs if l == lang for t in c)
        kept = [t for t, n in in_docs.items() if n >= least]
        sources = [s for l, s in groups if l == lang]
        counts = {s: Counter() for s in sources}
        for (l, s), c in docs:
            if l == lang:
                counts[s].update({t: n for t, n in c.items() if in_docs[t] >= least})
        counts[None] = sum((counts[s] for s in sources), Counter())
        p = {s: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            best = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, of in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(of, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_divergence_of_sources(spark, width):
    rows = word_rows()
    got = divergence.audit_sources(table(spark, rows), width=width)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergences(rows)


def test_divergence_of_few_and_none(spark):
    assert divergence.audit_sources(table(spark, [])).collect() == []
    alone = [(1, "word " * 20, "en", "s")] * 12
    assert sorted(tuple(r) for r in divergence.audit_sources(table(spark, alone)).collect()) == divergences(alone)
    # Without kept terms every pair has value 0 and ties go by bytes, not by letters.
    none = [(i, "x", "en", s) for i, s in enumerate(["b", "é", "Z", ""])]
    got = sorted(tuple(r) for r in divergence.audit_sources(table(spark, none)).collect())
    assert got == divergences(none) and all(r[4] == 0 for r in got)


def test_terms_of_bytes_and_letters():
    text = "".join(map(chr, range(300))) + " Straße ＡＢＣ  x y 🙂don't"
    assert [t.decode() for t in divergence.terms_of(text.encode())] == terms(text)
    assert divergence.terms_of(None) == []


def test_equal_subtrees_are_one_node():
    counts = np.array([[0, 0, 5, 0, 0, 0, 5, 0], [0, 0, 5, 0, 0, 0, 0, 0], [0] * 8])
    trees = divergence.Trees(counts)
    # Different pairs of leaves (00, 50), then of those, then roots: each stored once.
    assert [len(level) for level in trees.levels] == [2, 2, 3]
    walk, x, y, times = trees.walk(np.array([0]), np.array([1]))
    met = {(int(trees.leaves[a]), int(trees.leaves[b])): int(n) for a, b, n in zip(x, y, times)}
    assert met == {(0, 0): 6, (5, 5): 1, (5, 0): 1} and set(walk.tolist()) == {0}


def test_shares_do_not_overflow():
    count, total, kept = 3 * 10**14, 7 * 10**14, 10**9
    assert divergence.share(count, total, kept) == 1 + 10**9 * (count + 2) // (total + 2 * kept)


# ---- edit fingerprints


def plain_walk(text):
    """The walk of a whole text, step by step."""
    codes, table_ = editprint.codes_of(text), editprint.waits()
    mixed = editprint._mixed(codes.astype(np.uint64) + np.uint64(1))
    written, at = [], 0
    for m in mixed.tolist():
        wait = int(table_[m % editprint.CLASSES][at % editprint.PERIOD])
        written += [1 + (m >> 40) % 255] * wait
        at += wait
    return written


def plain_print(text):
    if not text:
        return "00:"
    c = next(c for c in range(200) if math.ceil(2 ** (c / 4)) >= len(text))
    upto = 2 * math.ceil(2 ** (c / 4))
    rank = editprint._mixed(np.arange(upto, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).tolist()
    asked = sorted(sorted(range(upto), key=rank.__getitem__)[: editprint.SAMPLES])
    written = plain_walk(text)
    return f"{c:02x}:" + bytes(written[j] if j < len(written) else 0 for j in asked).hex()


def plain_likeness(a, b):
    if a == b:
        return 1.0
    steps_of = lambda c: [int(x) for x in editprint.steps(c)]
    ca, cb = int(a[:2], 16), int(b[:2], 16)
    wa, wb = dict(zip(steps_of(ca), bytes.fromhex(a[3:]))), dict(zip(steps_of(cb), bytes.fromhex(b[3:])))
    if not wa or not wb or len(a) == 3 or len(b) == 3:
        return 0.0
    pairs = [(wa.get(j, 0), wb.get(j, 0)) for j in steps_of(max(ca, cb))]
    seen = [x == y for x, y in pairs if x or y]
    return sum(seen) / len(seen) if seen else 0.0


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text, *_), (_, after, *_) in zip(order, [*order[1:], *order[:1]]):
        text, after = text or "", after or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        a, b, c = plain_print(text), plain_print(changed), plain_print(after)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


@pytest.mark.parametrize("range_bytes", [200, 1 << 20])
def test_edit_fingerprints(spark, range_bytes):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("etaoin shrdlu äß🙂\n", k=n))
    rows = [(i * 7 % 101 - 50, text(rng.choice([0, 1, 2, 3, 5, 30, 150, 700, 3000])), "en", "s") for i in range(100)]
    rows += [(1000, None, None, None), (None, "no id", None, None), (-(2**63), "least", "", ""), (2**63 - 1, "most " * 9, "", "")]
    got = editprint.fingerprint_documents(table(spark, rows).repartition(5), range_bytes)
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()]
    assert sorted(found, key=lambda r: (r[0] is None, r[0])) == edits(rows)


def test_edit_fingerprints_of_few(spark):
    assert editprint.fingerprint_documents(table(spark, [])).collect() == []
    (one,) = editprint.fingerprint_documents(table(spark, [(1, "abcdefghi", "", "")])).collect()
    assert one.edited_text == "abcdefabc" and one.near_next == 1.0
    same = editprint.fingerprint_documents(table(spark, [(None, None, None, None)] * 3 + [(4, "x", "", "")] * 4), 1).collect()
    assert len(same) == 7 and len({r.fingerprint for r in same}) == 2 and sum(r.near_next == 0 for r in same) == 2


def test_a_long_text_is_walked_in_parts():
    text = "".join(random.Random(5).choices("abcdefgh ", k=200_000))
    assert editprint.fingerprint(text) == plain_print(text)


def test_likeness_follows_edits():
    rng = random.Random(11)
    text = "".join(rng.choices("etaoinshrdlu  ", k=4000))
    other = "".join(rng.choices("etaoinshrdlu  ", k=4000))
    at = {k: list(text) for k in (5, 40)}
    for k, chars in at.items():
        for _ in range(k):
            i = rng.randrange(len(chars))
            chars[i : i + 1] = rng.choice(["", "z", chars[i] + "q"])
    few, more, none = (editprint.likeness(editprint.fingerprint(text), editprint.fingerprint("".join(t))) for t in (at[5], at[40], other))
    assert few > 0.9 and few >= more > 0.4 and none < 0.3


def test_near_groups(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    bases = [text(rng.randint(300, 3000)) for _ in range(12)]
    rows, at = [], 0
    for b, base in enumerate(bases):
        for c in range(6):
            i = rng.randrange(len(base) - 40)
            rows.append((at, base if c < 2 else base[:i] + "Q" + base[i + 1 :], str(b), "s"))
            at += 1
    rows += [(500, None, "e", "s"), (501, "", "e", "s"), (None, bases[0], "0", "s")]
    prints = spark.createDataFrame([(i, editprint.fingerprint(t or "")) for i, t, *_ in rows], "doc_id long, fingerprint string")
    of = {r.doc_id: r.group_id for r in editprint.near_groups(prints, cell_rows=2).collect()}
    want = {**{i: i // 6 * 6 for i in range(at)}, 500: 500, 501: 500, None: 0}
    # Equal texts always meet and no two bases do; a walk that one edit sends out of step for long is the method's loss.
    assert all(of[i] in (want[i], i) for i in want) and all(of[i] == want[i] for i in want if i is None or i % 6 < 2)
    assert sum(of[i] == want[i] for i in range(at)) >= 0.95 * at
    assert editprint.near_groups(prints.limit(0)).collect() == []


# ---- fill-in-middle


def filled(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    pre, mid, suf = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    sizes = (None, None) if form == "plain" else (a, b - a)
    return doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out


def test_fill_in_middle(spark):
    rng = random.Random(2)
    texts = ["", None, "x", "äö🙂́<", "<P>", "a<S>b", "S>M>P><", "\0", "wide 🙂" * 5000, "a" * 300_000] + ["".join(rng.choices("ab<>PSM é🙂\n", k=rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "without an id", "", ""), (-5, "minus", "", ""), (3, "again", "", ""), (3, "again", "", "")]
    got = infill.fill_in_middle(table(spark, rows))
    found = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")) for r in got.collect()]
    assert sorted(found, key=repr) == sorted((filled(i, t) for i, t, *_ in rows), key=repr)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(table(spark, [])).collect() == []


def test_pieces_cover_the_text_once(spark):
    for r in infill.fill_in_middle(table(spark, [(i, "päíece " * (i % 5 + 1), None, None) for i in range(60)])).collect():
        own = sorted((p["from"], p["to"]) for p in r.pieces if p["buffer"] == infill.TEXT)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] == len(("päíece " * (r.doc_id % 5 + 1)).encode())


def test_cutting_pieces():
    pieces = [(0, 0, 4), (1, 2, 5)]
    assert infill.cut(pieces, 5) == [(0, 0, 4), (1, 2, 3), (1, 3, 5)]
    assert infill.cut(pieces, 0) == [(0, 0, 0), (0, 0, 4), (1, 2, 5)]
    assert infill.cut(pieces, 7) == [(0, 0, 4), (1, 2, 5), (1, 5, 5)]
    with pytest.raises(IndexError):
        infill.cut(pieces, 8)
