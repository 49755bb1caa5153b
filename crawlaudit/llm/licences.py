"""Licence scans (operator 8) by canonical digests.

A text is made canonical: lower case, without copyright lines, words only, equivalent spellings made one. The digest of the
whole canonical text is looked up in a hash join with the digests of known licences. Whole documents are looked up, and so
are their paragraphs and lines as texts of their own, for a licence seldom stands alone.

Full texts are also looked up where blank lines cut them inside a longer document: a run of paragraphs that begins like a
known text and has its length is one unit.

Making a unit canonical takes many passes, and a unit can only match if it opens with the first two words of a known text. One
pattern of these openings, in all their spellings, is tried on the unit as it stands, once over the whole document and then on
each unit; copyright lines, which vanish, may stand before or between. What does not open so is left alone.

A unit of a length that no known text has cannot match either, so only the rest are digested. The known texts are a fixed list
and their digests are broadcast; nothing else is. Only DataFrame operations run.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stage

# Short licences in full, and the notices by which licences are named.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Texts that stand under a title or none, with the titles in use.
TITLED = {
    "MIT": (TEXTS["MIT"], ["MIT License", "The MIT License", "The MIT License (MIT)"]), "ISC": (TEXTS["ISC"], ["ISC License", "The ISC License", "ISC License (ISC)"]),
    "BSD-3-Clause": (f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}", ["BSD 3-Clause License", "The BSD 3-Clause License"]),
    "BSD-2-Clause": (f"{_BSD_HEAD} {_BSD_TAIL}", ["BSD 2-Clause License", "The BSD 2-Clause License"]),
}
# Texts in files, each beginning with its title.
FILES = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense"],
}
NOTICES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This software is licensed under {}",
           "This project is licensed under {}", "SPDX-License-Identifier: {}"]
# Spellings that mean the same, as pattern and replacement on canonical words.
SPELLINGS = [(r"\blicence", "license"), (r"\bv([0-9])", "version $1"), (r"\bnon commercial", "noncommercial"), (r"\bshare alike", "sharealike"),
             (r"\bsub license", "sublicense"), (r"\bthe license\b", "license"), (r"\bunder the\b", "under"), (r"\bnon infringement", "noninfringement")]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|©)[^\n]*$"

# From this canonical length on, a known text may be cut into paragraphs.
LONG = 300


def canonical(text: Column) -> Column:
    return canonical_of_lower(F.lower(text))


def canonical_of_lower(lower: Column) -> Column:
    out = F.regexp_replace(lower, COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for pattern, instead in SPELLINGS:
        out = F.regexp_replace(out, pattern, instead)
    return out


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text.cast("binary"), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the fixed list."""
    named = [(licence, notice.format(form)) for licence, names in NAMES.items() for name in names for form in (name, "the " + name) for notice in NOTICES]
    return [*TEXTS.items(), *named]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of full texts in the forms in which they stand: with and without title and reserved rights."""
    out = []
    for licence, (body, titles) in TITLED.items():
        out += [(licence, f"{title}\n{rights}\n{body}") for title in ("", *titles) for rights in ("", "All rights reserved.")]
    for licence in FILES:
        text = (resources.files(__package__) / "licence_texts" / f"{licence}.txt").read_text("utf-8").strip()
        forms = [text]
        if licence == "Apache-2.0":
            forms += [text[: text.index("END OF TERMS AND CONDITIONS")], text[: text.index("APPENDIX:")], re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", text)]
        out += [(licence, form) for whole in forms for form in (whole, re.split(r"\n[ \t]*\n", whole, maxsplit=1)[1])]
    return out


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, size, licence), unique by digest."""
    table = spark.createDataFrame(texts or [*known_texts(), *full_texts()], "licence string, text string").withColumn("c", canonical(F.col("text")))
    return table.groupBy(digest(F.col("c")).alias("digest"), F.length("c").cast("long").alias("size")).agg(F.min("licence").alias("licence"), F.first("c").alias("c"))


_GAP = r"[^\p{L}\p{N}]+"


def _spellings(word: str) -> str:
    """A pattern of what may stand in a text, in lower case, where its canonical form has ``word``."""
    word = re.escape(word)
    for joined, first in (("noncommercial", "non"), ("sharealike", "share"), ("sublicense", "sub"), ("noninfringement", "non")):
        if word.startswith(joined):
            word = f"{first}(?:{_GAP})?{word[len(first):]}"
    word = "(?:version|v[0-9])" if word == "version" else word
    return word.replace("license", "licen[cs]e")


def openings(heads: list[str]) -> str:
    """A pattern of the first two words of the canonical texts ``heads``, as they may be spelled; one word ends its line or text."""
    second: dict[str, set[str]] = {}
    for head in heads:
        first, _, rest = head.partition(" ")
        second.setdefault(first, set()).add(rest.split(" ")[0])
    branches = []
    for first, rests in sorted(second.items()):
        lead = f"(?:the{_GAP})?" if first.startswith("license") else ""
        # "the" vanishes behind "under" and before "license"; a copyright line may follow the first word.
        follow = "|".join(_spellings(r) for r in sorted(rests) if r)
        follow = f"{_GAP}(?:the{_GAP})?(?:{follow})|" if follow else ""
        branches.append(rf"{lead}{_spellings(first)}(?:{follow}[^\p{{L}}\p{{N}}\n]*(?:\n|\z))")
    return rf"[^\p{{L}}\p{{N}}]*+(?:{'|'.join(branches)})"


def runs(text: Column, heads: list[str], sizes: list[int]) -> Column:
    """Canonical runs of paragraphs that begin with one of ``heads``, the first words of known texts, and have one of the sizes."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), canonical_of_lower), lambda c: F.length(c) > 0)
    # Where each paragraph begins in the canonical text, and one past the end: a run's length is a difference less the blank.
    edges = F.aggregate(parts, F.array(F.lit(0)), lambda all_, c: F.concat(all_, F.array(F.element_at(all_, -1) + F.length(c) + 1)))
    begins = F.filter(F.transform(parts, lambda c, i: F.when(F.arrays_overlap(F.array(*[F.substring(c, 1, len(h)) for h in heads]), F.array(*map(F.lit, heads))), i)), F.isnotnull)
    both = F.struct(F.array_join(parts, " ").alias("joined"), edges.alias("edges"), begins.alias("begins"))
    known = F.array(*[F.lit(n) for n in sizes])
    ends = lambda of, at: F.filter(known, lambda n: F.array_contains(of["edges"], at + n + 1))
    found = lambda of: F.flatten(F.transform(of["begins"], lambda i: F.transform(ends(of, of["edges"][i]), lambda n: F.substring(of["joined"], of["edges"][i] + 1, n))))
    return F.flatten(F.transform(F.array(both), found))


def scan_licences(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, licence, n_notices, notices) of every row.

    ``licence`` is that of the whole text, else null. ``n_notices`` counts the lines that are a known text by themselves,
    and ``notices`` lists the licences of all units in order. Null and empty text has none. Repeated rows give repeated
    rows, an empty table gives none, and other columns are not read.
    """
    known = stage(known_digests(docs.sparkSession, texts), "known")
    fixed = known.select("size", F.substring("c", 1, 100).alias("head")).collect()  # the fixed list
    sizes, opening = sorted({r["size"] for r in fixed}), openings([r["head"] for r in fixed])
    # The long ones may be cut by blank lines.
    long = [(r["size"], " ".join(r["head"].split()[:3])) for r in fixed if r["size"] >= LONG]
    heads = sorted({h for _, h in long})
    text = F.col("lower")
    begun = text.rlike("|".join(h.replace(" ", r"[^\p{L}\p{N}]+").replace("license", "licen[cs]e") for h in heads)) if heads else F.lit(False)
    none = F.array().cast("array<string>")
    cut = F.when(begun, runs(text, heads, sorted({n for n, _ in long}))).otherwise(none)
    fit = lambda c: F.length(c).isin(sizes)
    opens = lambda x: x.rlike(rf"\A(?:{opening}|[^\p{{L}}\p{{N}}]*+(?:copyright|c(?![\p{{L}}\p{{N}}]))|[^\p{{L}}\p{{N}}©]*+©)")
    units_of = lambda parts: F.filter(F.transform(F.filter(parts, opens), canonical_of_lower), fit)
    lines = units_of(F.split(text, "\n"))
    paragraphs = units_of(F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda x: F.contains(x, F.lit("\n"))))
    whole = units_of(F.array(text))
    unit = lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), digest(c).alias("digest"))
    units = F.concat(F.transform(whole, unit("whole")), F.transform(cut, unit("run")), F.transform(paragraphs, unit("paragraph")), F.transform(lines, unit("line")))
    units = F.when(text.rlike(f"(?m)^{opening}"), units)
    lower = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("lower"))
    rows = stage(lower.select("doc_id", F.monotonically_increasing_id().alias("row"), units.alias("units")), "units")
    found = rows.select("row", F.explode("units").alias("u")).select("row", "u.kind", "u.digest").join(F.broadcast(known.drop("c")), "digest")
    found = found.groupBy(F.col("row").alias("of")).agg(
        F.max(F.when(F.col("kind") == "whole", F.col("licence"))).alias("licence"), F.sum((F.col("kind") == "line").cast("long")).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    out = rows.select("doc_id", "row").join(found, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", "licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
