"""Joins and size checks that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.plans.session import cut_lineage

_SALT = "__salt"
_PARTS = "__parts"


def heavy_keys(key_counts: DataFrame, key: str, n: str, parts: int, total: int) -> DataFrame:
    """Keys holding more than 1/parts of all rows, with the number of pieces to cut them into.

    At most ``parts`` keys can hold more than that share, so the result is bounded by ``parts``.
    """
    pieces = F.ceil(F.col(n) * parts / F.lit(total)).cast("int").alias(_PARTS)
    return key_counts.where(F.col(n) * parts > total).select(key, pieces)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    key_counts: DataFrame | None = None,
    n: str = "n",
    how: str = "inner",
    parts: int | None = None,
) -> DataFrame:
    """Equi-join on ``key`` in which heavy keys of ``big`` are spread over several tasks.

    One look at the counts per key comes first: ``key_counts`` (key, n) where they are known, else a
    partial aggregation over ``big``. Without a heavy key the join stays a plain one. With some, at
    most ``parts`` keys are stored, and ``small`` rows are repeated for those alone.
    """
    if how not in ("inner", "left"):
        raise ValueError("rows of the small side are repeated, so only inner and left joins keep their meaning")
    spark = big.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if key_counts is None:
        key_counts, n = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "__n"
    top, total = key_counts.agg(F.max(n), F.sum(n)).first()
    if (top or 0) * parts <= (total or 0):
        return big.join(small, key, how)
    heavy = F.broadcast(cut_lineage(heavy_keys(key_counts, key, n, parts, total), "heavy"))
    # the salt comes from the row's own content: a retried task spreads its rows the same way
    spread = F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.coalesce(_PARTS, F.lit(1)))
    left = big.join(heavy, key, "left").withColumn(_SALT, spread.cast("int")).drop(_PARTS)
    right = (
        small.join(heavy, key, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1)))
        .drop(_PARTS)
    )
    return left.join(right, [key, _SALT], how).drop(_SALT)


#: A Parquet writer's usual row group: a split without the middle of one holds no rows.
ROW_GROUP_BYTES = 128 << 20
#: Tables below this are one task's work.
WORTH_DEALING = 64 << 10


def spread_out(df: DataFrame) -> DataFrame:
    """Deal the rows of stored files over all cores where they sit in fewer row groups than there are cores.

    Splits do not tell: a file of one row group may be cut into many, all but one of them empty. There are about as many row
    groups as files and whole ``ROW_GROUP_BYTES`` together, so at most that many bytes a core are shuffled; a larger input is
    left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < WORTH_DEALING or size >= cores * ROW_GROUP_BYTES:
        return df
    groups = len(df.inputFiles()) + size // ROW_GROUP_BYTES
    return df.repartition(cores) if groups < cores else df
