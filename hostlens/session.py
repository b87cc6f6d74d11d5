"""Session set-up and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# whether the shuffle files of an execution go when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the cluster's own.

    `memory` is the heap of the one process, Spark's default unless given.
    """
    builder = SparkSession.builder if memory is None else SparkSession.builder.config(
        "spark.driver.memory", memory)
    return (
        builder.master(f"local[{cores}]")
        .appName("hostlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set to a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="hostlens-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files when they end.

    Else the files fill the disk until the driver collects its garbage.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Cut the lineage: write the frame once to the shared folder and read it back.

    The written table survives lost executors, and each reader scans only the
    columns it needs. The shuffle files of the write are read by nothing else and go when
    it ends. A `path` below the shared folder may be given, to write over a table that is
    no longer read.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    """Whether a frame has no rows.

    Unlike those of `isEmpty`, the shuffle files of a count go when it ends.
    """
    with shuffles_removed(df.sparkSession):
        return df.limit(1).count() == 0


def cut_in_turn(frames: Iterable[DataFrame], name: str = "step") -> DataFrame:
    """Write frames of one schema to one table, each made when the one before is written."""
    path = None
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        path = path or scratch_path(spark, name)
        with shuffles_removed(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
