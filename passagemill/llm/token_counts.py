"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Each text is encoded once; from then on only (length, documents) is handled, at most one row for every length that
occurs. With, for each length, the documents and tokens at or above it, totals, quantiles and the total of all texts
cut at any limit are read off a single row.

Defined results: a null text has length 0, as an empty one; repeated rows count as often as they come; an empty table
gives no rows, and null answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import slices, texts
from passagemill.llm.tokens import Encoder, default_tokenizer
from passagemill.plans.session import cut_lineage

_RANGE = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(encoder.counts(texts(batch)))], ["length"])

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents, stored: texts are encoded once, however often it is read."""
    lengths = docs.select("text").mapInArrow(_lengths(tokenizer or default_tokenizer()), "length long")
    return cut_lineage(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` with docs_at_least, tokens_at_least (this length included), docs_at_most, quantile and truncated_total.

    ``quantile`` is the share of documents no longer than this; ``truncated_total`` the tokens left when every text is
    cut at this length. Sums run over ranges of 1,024 lengths first, then inside a range.
    """
    h = hist.withColumn("_range", F.floor(F.col("length") / _RANGE)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    ranges = h.groupBy("_range").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    # one row for every 1,024 lengths up to the longest text
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_docs").over(every).alias("_all_docs"),
        F.sum("_tokens").over(every).alias("_all_tokens"),
    )
    here = Window.partitionBy("_range").orderBy(F.desc("length"))
    sums = h.join(ranges, "_range").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("_docs_above") + F.sum("n_docs").over(here)).alias("docs_at_least"),
        (F.col("_tokens_above") + F.sum("n_tokens").over(here)).alias("tokens_at_least"),
        "_all_docs",
        "_all_tokens",
    )
    at_most = F.col("_all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        at_most.alias("docs_at_most"),
        (at_most / F.col("_all_docs")).alias("quantile"),
        (F.col("_all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        F.col("_all_tokens").alias("total_tokens"),
        F.col("_all_docs").alias("total_docs"),
    )


def answers(sums: DataFrame, limits: list[int], shares: list[float]) -> DataFrame:
    """One row: total, ``cut_<limit>`` for each context limit, ``q_<i>`` for each share, from the suffix sums."""
    out = [F.max("total_tokens").alias("total_tokens"), F.max("total_docs").alias("total_docs")]
    for limit in limits:
        # the first length at or above the limit: what lies below is whole, the rest is cut
        below = F.col("total_tokens") - F.col("tokens_at_least") + limit * F.col("docs_at_least")
        at = F.min_by(below, F.when(F.col("length") >= limit, F.col("length")))
        out.append(F.coalesce(at, F.max("total_tokens")).alias(f"cut_{limit}"))
    for i, share in enumerate(shares):
        out.append(F.min(F.when(F.col("quantile") >= share, F.col("length"))).alias(f"q_{i}"))
    return sums.agg(*out)
