"""Corpus pipeline: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. Rejected documents go; of each group of
near copies one document stays; passages of 200 bytes or more that repeat keep their first copy; personal data is
masked; what is left is packed into training sequences. SQL cannot express the stages: their composition is tested
against brute force on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm import bpe, jaccard, packing, pii, quality, suffix
from episodica.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    return quality.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity of 0.8 or more."""
    return jaccard.representatives(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated passages removed."""
    return suffix.without_repeats(docs, keep="first")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in a packed row."""
    return packing.packed(docs, bpe.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents, each written and read again but the last, which is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
