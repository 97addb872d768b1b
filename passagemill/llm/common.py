"""What several operators of this folder share: Arrow slices, words of a batch, ranks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.plans.session import cut_lineage

#: Lowest 64-bit number; stands for a missing id wherever ids are ordered.
NO_ID = -(1 << 63)

SLICE_BYTES = 6 << 20


def id_or_lowest(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with marks added until no column of ``df`` has it: for columns that a join adds for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes (a longer text is a batch alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return pc.fill_null(column(batch, name), "")


def words(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of anything but ``[\\x20\\x09-\\x0D]`` of all texts, coded, and the number of them in each text."""
    cut = pc.ascii_split_whitespace(text)
    counts = np.diff(cut.offsets.to_numpy()).astype(np.int64)
    flat = cut.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        rows = np.repeat(np.arange(len(text)), counts)[full.to_numpy(zero_copy_only=False)]
        counts = np.bincount(rows, minlength=len(text)).astype(np.int64)
        flat = flat.filter(full)
    return pc.dictionary_encode(flat), counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of ``values``; 0 for a text without any."""
    whole = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    ends = np.cumsum(counts)
    return whole[ends] - whole[ends - counts]


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the gapless place (from 0) of each row among those of its ``key``.

    A key may hold any share of the rows: ranks are taken inside blocks of a key, and each block starts where
    the blocks before it end. The block comes from the content of the row, so that a repeated task deals alike.
    Rows equal in all of ``order`` must be equal altogether.
    """
    parts = max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocked = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    placed = blocked.withColumn("_row", F.row_number().over(inside) - 1)
    return placed.join(offsets, [key, "_block"]).withColumn(name, F.col("_row") + F.col("_base")).drop("_block", "_row", "_base")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node of each component of ``edges`` (u, v), for nodes that have an edge.

    Alternating star contraction; each round is a written table. Lowest neighbours come from partial aggregation,
    and the joins are on the node alone, so that adaptive execution may split a hub.
    """
    e = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = cut_lineage(small.unionByName(low.withColumnRenamed("low", "v")).where("u <> v").distinct(), "small")
        after = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
