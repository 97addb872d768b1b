"""From documents to packed training sequences: rules, line dedup, near-dedup, decontamination, packing.

Every stage works on all rows that the one before it kept, and is written as Parquet before the next reads it. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from passagemill.plans.session import cut_lineage


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.keep_good(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents have stay in one of them only."""
    return line_dedup.drop_lines(docs)


def _copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, a similarity of 0.8)."""
    return simhash.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4,096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", _rules),
    ("line dedup", _lines),
    ("near-duplicates", _copies),
    ("decontamination", _benchmark),
    ("packing", _sequences),
]

# Token ids and fingerprints are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
