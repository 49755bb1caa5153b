"""From raw documents to packed sequences: five stages, each one operator of ``crawlaudit.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlaudit.llm import exact, language, mixing, pack, simhash
from crawlaudit.llm.common import read, stage

# Share of the tokens that the mix takes.
MIX_FRACTION = 0.8


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; texts without a letter and ties between languages go."""
    return language.known_language(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact.without_copies(docs)


def distinct_prints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once."""
    return mixing.keep_mix(docs, MIX_FRACTION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack.pack_documents(docs)


STAGES = [("language", identified), ("exact_dedup", distinct_texts), ("near_dedup", distinct_prints), ("mixing", mixed), ("packing", packed)]

# Compression, fingerprint trees and tokens are beyond SQL; the tests rebuild each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
