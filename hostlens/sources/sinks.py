"""Result tables on disk: features, calibration, reports, profile."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.sources.replace import recovered, replace_tables


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at the path once the new one is whole."""
    replace_tables({path: df})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(recovered(spark, path))


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines; nulls are kept."""
    replace_tables({path: df}, "json", {"ignoreNullFields": "false"})


def save_calibrator(line: DataFrame, path: str) -> None:
    """The one-row result of a fit."""
    replace_tables({path: line.select("slope", "intercept").coalesce(1)}, "json")


def load_calibrator(spark: SparkSession, path: str) -> tuple[float, float] | None:
    """(slope, intercept); None when the file is absent or not readable as such."""
    schema = "slope string, intercept string, bad string"
    try:
        row = (
            spark.read.schema(schema)
            .option("columnNameOfCorruptRecord", "bad").json(recovered(spark, path))
            .select(
                "bad", F.col("slope").try_cast("double").alias("slope"),
                F.col("intercept").try_cast("double").alias("intercept"),
                F.col("slope").alias("slope_text"), F.col("intercept").alias("intercept_text"),
            )
            .first()
        )
    except AnalysisException:
        return None
    if row is None or row["bad"] is not None:
        return None
    unreadable = any(
        row[f"{n}_text"] is not None and row[n] is None for n in ("slope", "intercept")
    )
    if unreadable:
        return None
    slope = 1.0 if row["slope"] is None else row["slope"]
    intercept = 0.0 if row["intercept"] is None else row["intercept"]
    return slope, intercept
