"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import math
import re

import numpy as np
import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def repeats(rows, window):
    first = {}
    docs = [(i, math.inf if i is None else i, words(t)) for i, t in rows]
    for _, order, w in docs:
        for p in range(len(w) - window + 1):
            at = tuple(w[p : p + window])
            first[at] = min(first.get(at, order), order)
    out = []
    for i, order, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < order:
                gone.update(range(p, p + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if group[j] < group[i] and (a ^ b).bit_count() <= 3:
                    group[i], changed = group[j], True
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted([(i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, prints, group)], key=key)


def one_of_each(rows):
    """doc_ids that stay: three bits of the fingerprint, or four fifths of the five-word shingles, make a group."""
    prints = [fingerprint(t) for _, t in rows]
    folded = [words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in folded]
    alike = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if alike(i, j):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return set(least.values())


def exact(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(BLANK.sub(" ", t or ""), []).append((i is None, i or 0, n, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        # Which of the rows that repeat the smallest doc_id stays is not said: only how many.
        out += [(m[3], keep[3], len(members), digest) for m in members]
    return sorted(out, key=key)


def nearest(rows, top, asks):
    fit = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = [i for i, _ in sorted(fit)]
    vectors = np.array([v for _, v in sorted(fit)])
    out = []
    for n, i in enumerate(ids):
        if asks(i):
            cos = (vectors * vectors[n]).sum(1) / np.sqrt((vectors**2).sum(1)) / np.sqrt((vectors[n] ** 2).sum())
            order = [j for j in np.lexsort((ids, -cos)) if ids[j] != i][:top]
            out += [(i, r, ids[j]) for r, j in enumerate(order, 1)]
    return sorted(out)
