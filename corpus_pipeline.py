"""Corpus preparation: language ID, exact dedup, SimHash near-dedup, best-fit packing.

``STAGES`` lists the steps; each takes (spark, docs, sf_dir) and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``; the last returns the
packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsynth.llm.catalog import _vocabulary
from tabsynth.llm.common import table, written
from tabsynth.llm.exact_dedup import drop_exact_duplicates
from tabsynth.llm.language_id import keep_identified
from tabsynth.llm.packing import pack_documents
from tabsynth.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go."""
    return keep_identified(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (3-word shingles, 2 bits) the smallest id stays."""
    return drop_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as sequences of at most 2048 tokens."""
    return pack_documents(spark, docs, _vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # the classifier, fingerprints and tokenizer are not SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
