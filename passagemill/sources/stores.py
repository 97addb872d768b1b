"""Sinks and the codecs to read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import vectors as V


# The last two use a mark that the first has made impossible in the text.
ESCAPES = [("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")]


def _texts(df: DataFrame, vec: str, changes: list[tuple[str, str]]) -> DataFrame:
    """Every text column but ``vec`` with the changes made; undoing goes the other way round."""
    undo = changes[0][1] == "\\"
    for name, kind in df.dtypes:
        if kind == "string" and name != vec:
            out = F.col(name)
            for a, b in changes[::-1] if undo else changes:
                out = F.replace(out, F.lit(a), F.lit(b))
            df = df.withColumn(name, out)
    return df


def write_vectors_csv(df: DataFrame, path: str, vec: str = "vec", mode: str = "errorifexists") -> None:
    """Table with its vector as bracketed text.

    Line ends inside other texts are escaped by a backslash, so that a row is a line and the files can be split.
    """
    (
        _texts(df.withColumn(vec, V.to_text(F.col(vec))), vec, ESCAPES)
        .write.mode(mode)
        .csv(path, header=True, quoteAll=True, escape='"')
    )


def read_vectors_csv(spark: SparkSession, path: str, schema: str, vec: str = "vec") -> DataFrame:
    """``schema`` lists the stored columns; the vector column is text in the file."""
    raw = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')
    return _texts(raw, vec, [(b, a) for a, b in ESCAPES]).withColumn(vec, V.from_text(F.col(vec)))


def write_vectors_parquet(
    df: DataFrame, path: str, cell: str | None = None, mode: str = "errorifexists", packed: str | None = None
) -> None:
    """Lossless store; with ``cell`` it is laid out by cell so that a probe reads few folders.

    Rows are rebalanced by cell first: a folder gets few files, and a cell holding a third of all
    rows is split over several writers. ``packed`` names a vector column to store as bytes, which
    the searches read as it is.
    """
    if packed:
        df = df.withColumn(packed, V.pack(F.col(packed)))
    if cell:
        df.hint("rebalance", cell).write.mode(mode).partitionBy(cell).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def is_built(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a finished table: the writer leaves its success marker last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def save_index(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Build if absent, keep otherwise; replace on request.

    A folder counts as built once it has the writer's success marker; what a failed job left is replaced.
    """
    if overwrite or not is_built(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)


def metric_maps(metrics: DataFrame) -> DataFrame:
    """dataset -> {metric: value}. A dataset has as many entries as there are metric names."""
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return metrics.groupBy("dataset").agg(F.map_from_entries(entries).alias("metrics"))


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    metric_maps(metrics).write.mode(mode).json(path)
