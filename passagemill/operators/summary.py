"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.plans.session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)


def _quantiles_by_range(counted: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """(metric, q): exact interpolated quantiles without one task holding a metric's values.

    Values are range-partitioned and each range's total is taken; the totals say which ranges hold
    the wanted ranks, and only those few ranges are numbered through, each in a task of its own.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(counted.repartitionByRange(parts, "metric", "value").withColumn("range_no", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("metric", "range_no").agg(F.sum("n").alias("n"))  # at most parts rows per metric
    before = F.sum("n").over(Window.partitionBy("metric").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    spans = totals.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("metric")))
    at = F.explode(F.array(*[F.lit(p) for p in probs])).alias("p")
    place = F.col("p") * (F.col("total") - 1)
    ranks = spans.select("metric", "range_no", "n", "before", "total", at).select(
        "metric", "range_no", "n", "before", "p", place.alias("place"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank_no")
    )
    wanted = ranks.distinct().where("rank_no >= before AND rank_no < before + n").drop("n")
    held = placed.join(wanted.select("metric", "range_no", "before").distinct(), ["metric", "range_no"])
    up_to = F.sum("n").over(Window.partitionBy("metric", "range_no").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    numbered = held.withColumn("stop", up_to + F.col("before")).withColumn("start", F.col("stop") - F.col("n")).drop("before")
    found = numbered.join(wanted, ["metric", "range_no"]).where("rank_no >= start AND rank_no < stop")
    share = F.col("place") - F.floor("place")
    low, high = F.min("value"), F.max("value")
    each = found.groupBy("metric", "p").agg((low + (high - low) * F.first(share)).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("p", "v")))  # one entry per asked quantile
    return each.groupBy("metric").agg(F.transform(listed, lambda x: x["v"]).alias("q"))


def describe_numeric(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max per column, two decimals.

    Rows are counted per distinct value first; quartiles come from a range-partitioned search over the counts, the
    deviation from the distances to the mean, which large values do not wash out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    if approximate:
        stats = values.groupBy("metric").agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.percentile_approx("value", list(QUARTILES), 10000).alias("q"),
            F.max("value").alias("max"),
        )
    else:
        v, n = F.col("value"), F.col("n")
        counted = cut_lineage(values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n")), "values")
        total = F.sum("n")
        basic = counted.groupBy("metric").agg(
            total.alias("count"), (F.sum(v * n) / total).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
        )
        basic = cut_lineage(basic, "means")  # a row for each column
        apart = counted.join(basic.select("metric", "mean"), "metric").groupBy("metric").agg(F.sum((v - F.col("mean")) ** 2 * n).alias("apart"))
        std = F.when(F.col("count") > 1, F.sqrt(F.col("apart") / (F.col("count") - 1))).alias("std")
        spread = basic.join(apart, "metric").select("metric", "count", "mean", std, "min", "max")
        stats = spread.join(_quantiles_by_range(counted, QUARTILES), "metric")
    q = F.col("q")
    return stats.select(
        "metric",
        "count",
        *[
            F.bround(c, 2).alias(name)
            for name, c in (
                ("mean", F.col("mean")),
                ("std", F.col("std")),
                ("min", F.col("min")),
                ("q25", q[0]),
                ("q50", q[1]),
                ("q75", q[2]),
                ("max", F.col("max")),
            )
        ],
    )


def corpus_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def corpus_shape(pages: DataFrame, doc: str, words: str) -> DataFrame:
    """Words and pages per document, averaged and at most. Two levels, both combined map-side."""
    per_doc = pages.groupBy(doc).agg(F.sum(words).alias("doc_words"), F.count(F.lit(1)).alias("doc_pages"))
    return per_doc.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg("doc_words"), 6).alias("avg_words"),
        F.round(F.avg("doc_pages"), 6).alias("avg_pages"),
        F.max("doc_words").alias("max_words"),
        F.max("doc_pages").alias("max_pages"),
    )


def question_type_matrix(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts by question type and answer type; the listed answer types keep the pivot one pass."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def scenario_accuracy(df: DataFrame, scenario: str, correct: str) -> DataFrame:
    return (
        df.rollup(scenario)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 1, "(all)").otherwise(F.col(scenario)).alias("scenario"),
            "n",
            F.round("accuracy", 6).alias("accuracy"),
        )
    )
