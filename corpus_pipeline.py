"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Rejected languages go, later repeats of runs of lines and of passages are cut, one document of each near-duplicate group
stays, benchmark passages are cut out, and the rest is encoded and decoded.

Every stage takes null, empty and very long texts, ties, repeated rows, empty tables and extra columns as the function that it calls says;
columns beyond those of ``documents`` are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import bpe, decontamination, language, lines, simhash
from panelweave.llm.common import staged, table
from panelweave.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier, fitted on ``docs``, does not reject."""
    return language.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of three or more lines, or of fewer lines with fifty or more words."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group (3-word shingles, 3 bits)."""
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that they share with test items."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, as op5 returns them."""
    return bpe.report(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_pairs", byte_pairs),
]

#: Neither the fitted classifier nor XXH64 and byte-pair merges exist in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
