"""Language identification (operator 9) by compression.

One raw-content zstandard dictionary per language is made from a bounded sample of labelled documents. A text is cut into
chunks, each chunk is compressed with every dictionary, and the language whose dictionary gives the fewest bytes is
chosen. The margin is the share that it saves over the second best; a narrow one means that the text is rejected.

Learning takes ``SAMPLE_DOCS`` documents of each language in the order of a hash of doc_id, ``SAMPLE_CHARS`` characters of
each and ``DICTIONARY_BYTES`` in all, of the ``MAX_LANGUAGES`` most frequent languages: that bounds what the driver and the
tasks hold, whatever the corpus. Prediction reads whole texts and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

SAMPLE_DOCS = 400
SAMPLE_CHARS = 600
DICTIONARY_BYTES = 131_072
MAX_LANGUAGES = 256
CHUNK = 4096
LEVEL = 6
# Few bytes decide a short text: it gets a stronger search, and a run of zeros before it that any dictionary packs to the
# same few bytes, for else the block would be stored as it is and every language would tie.
SHORT, SHORT_LEVEL, SHORT_MATCH = 512, 19, 3
LEAD = bytes(256)
MIN_MARGIN = 0.0002
UNKNOWN = "und"


def held_out():
    """Documents that learning never sees: a third by the checksum of doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary content of each language from labelled documents (doc_id, text, lang) that are not held out."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    labelled = labelled.select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("text"))
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang")
    # In two steps, so that what tasks hand on does not meet in one task for each language.
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")
    for lane in (F.spark_partition_id() % 64, F.lit(0)):
        first = Window.partitionBy("lang", "lane").orderBy(*order)
        labelled = labelled.withColumn("lane", lane).withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs).drop("n", "lane")
    sample = labelled.join(F.broadcast(common), "lang")
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.collect()):
        texts.setdefault(row["lang"], []).append(row["text"].lower())
    return {lang: "\n".join(dict.fromkeys(of)).encode()[:size] for lang, of in texts.items()}


class Classifier:
    """Picks the language whose dictionary compresses a text best."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.tools = {lang: (self._tool(data), self._short_tool(data)) for lang, data in sorted(dictionaries.items()) if data}

    @staticmethod
    def _tool(data: bytes):
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

    @staticmethod
    def _short_tool(data: bytes):
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            SHORT_LEVEL, dict_size=len(data), source_size=SHORT, min_match=SHORT_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=content)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.tools or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = text.lower().encode()
        short = len(data) <= SHORT
        chunks = [LEAD + data] if short else [data[a : a + CHUNK] for a in range(0, len(data), CHUNK)]
        sizes = sorted((sum(len(tools[short].compress(c)) for c in chunks), lang) for lang, tools in self.tools.items())
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns of ``docs`` in ``d``, with lang_pred, score and rejected.

    Null text, and text without a letter, is ``und`` with score 0; so is every text when nothing was learned. Ties go to
    the first language by name, with score 0. ``rejected`` says that the text is ``und`` or its margin is narrow.
    """
    fields = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Classifier(dictionaries)
        for batch in batches:
            found = [tool(t) for t in batch.column(1).to_pylist()]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            rejected = [lang == UNKNOWN or score < min_margin for lang, score in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["d", "lang_pred", "score", "rejected"])

    kind = fields.schema["d"].dataType.simpleString()
    return fields.mapInArrow(run, f"d {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document, learned from its labelled ones.

    A null doc_id is never learned from and not held out. An empty table gives no rows.
    """
    found = classify(docs.select("doc_id", "text"), learn(docs), min_margin)
    return found.select("d.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", held_out())


def known_language(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns as they were."""
    return classify(docs, learn(docs), min_margin).where("not rejected").select("d.*")
