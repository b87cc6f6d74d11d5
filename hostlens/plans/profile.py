"""A profile that is kept up as files arrive: one state row for each file, merged on reading."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.clean import missing_to_null
from hostlens.operators.profiling import is_stay
from hostlens.session import cut
from hostlens.sources.images import file_uri, plain_path
from hostlens.sources.replace import replace_tables
from hostlens.sources.sinks import read_table

SKETCH_BITS = 12  # relative error of the distinct count: about 1.04 / sqrt(2 ** SKETCH_BITS)
_KNOWN_BY = ["file", "length", "modified"]
_COUNTS = ("rows", "stay", "amenities")


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, modified) of the Parquet files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(folder)
    return files.select(plain_path(F.col("path")).alias("file"), "length",
                        F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Listing rows of the files, missing words as null, with the `file` they are from."""
    rows = spark.read.option("mergeSchema", "true").parquet(*[file_uri(f) for f in files])
    cells = [missing_to_null(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`")
             for c, kind in rows.dtypes if c not in ("row_key", "file")]
    return rows.select(*cells, plain_path(F.col("_metadata.file_path")).alias("file"))


def file_states(listings: DataFrame) -> DataFrame:
    """One row for each `file`: counts, nulls by column, and a sketch of its cities."""
    names = [c for c in listings.columns if c != "file"]
    nulls = F.map_from_arrays(
        F.array(*[F.lit(c) for c in names]),
        F.array(*[F.count_if(F.col(f"`{c}`").isNull()) for c in names]))
    return listings.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_stay(listings)).alias("stay"),
        F.count("amenities").alias("amenities"), nulls.alias("nulls"),
        F.hll_sketch_agg("city", SKETCH_BITS).alias("cities"))


def update_profile(spark: SparkSession, folder: str, state: str) -> int:
    """Bring the state table up to the files of a folder; returns how many files were read.

    Files known with the same length and time are not read again, files that have changed
    are, and files that are gone lose their row. The state is replaced as a whole: an update
    that fails leaves the old one.
    """
    files = cut(listed_files(spark, folder), "listed")
    try:
        known = read_table(spark, state)
    except AnalysisException:
        known = None
    fresh = files if known is None else files.join(
        known.select(*_KNOWN_BY), _KNOWN_BY, "left_anti")
    fresh = cut(fresh, "fresh")
    names = [r["file"] for r in fresh.select("file").collect()]  # a scan is planned by its files
    kept = None if known is None else known.join(files, _KNOWN_BY, "left_semi")
    if names:
        found = fresh.join(file_states(read_files(spark, names)), "file", "left").select(
            *_KNOWN_BY, *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS], "nulls", "cities")
        kept = found if kept is None else kept.unionByName(found)
    if kept is not None:
        replace_tables({state: kept})
    return len(names)


def merged_profile(state: DataFrame) -> DataFrame:
    """The listing section of the profile from its state; the number of cities is an estimate.

    Its rows are those of `profiling.listing_counts`. A column that only some files have
    counts as missing in the files scanned together with one that has it.
    """
    totals = state.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS],
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("cities")), F.lit(0)).alias("cities"))
    named = {"rows": "total rows", "stay": "stay listings", "cities": "unique cities",
             "amenities": "with amenities"}
    counts = totals.select(F.inline(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit("").alias("key"),
                 F.col(c).cast("double").alias("value")) for c, metric in named.items()])))
    nulls = state.select(F.explode("nulls").alias("key", "n")).groupBy("key").agg(
        F.sum("n").cast("double").alias("value")).filter("value > 0").select(
        F.lit("missing values").alias("metric"), "key", "value")
    return counts.unionByName(nulls).select(F.lit("listings").alias("section"), "metric", "key", "value")
