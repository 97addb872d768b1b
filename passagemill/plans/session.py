"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_STEPS = "passagemill.steps.folder"


def local_session(cores: int | str = 8, name: str = "passagemill") -> SparkSession:
    """Session for tests and the bench. On a cluster the submitter's settings are used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local run that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("passagemill.local.folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("passagemill.local.folder", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has been written to yet."""
    folder = spark.conf.get(_STEPS, None) or shared_folder(spark)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def steps(spark: SparkSession) -> Iterator[str]:
    """Steps stored inside the block go to one folder, which is deleted with all of them at its end.

    Use it around a whole job: what the job returns must be written elsewhere before the block ends.
    """
    before = spark.conf.get(_STEPS, None)
    folder = f"{shared_folder(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    spark.conf.set(_STEPS, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(_STEPS) if before is None else spark.conf.set(_STEPS, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A lost executor never replays earlier work, and the planner sees the true size, so the next join
    broadcasts this side only when it really is small.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
