"""Image files: which exist, and their decoded pixels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.pixels import flat_images, photo_metrics
from hostlens.schemas import PHOTO_METRICS
from hostlens.session import cut, scratch_path
from hostlens.sources.replace import is_there

# image files whose names the driver holds at a time, as the plan of one scan
FILES_PER_SCAN = 200_000
# how many bytes of listed files the driver keeps, though no later scan finds them again
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"
# what an image that can't be read measures; it has no hash
_INVALID = {"valid": False, "width": 0, "height": 0, "sharpness": 0.0, "colorfulness": 0.0,
            "contrast": 0.0, "brightness": 0.0}


def plain_path(c):
    """A path without its file: scheme."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))),
                            r"^file:(?://(?=/))?", "")


def file_uri(path: str) -> str:
    """What a reader opens for a plain path; glob signs are taken literally."""
    escaped = re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
    return f"file:{escaped}" if path.startswith("/") else escaped


def fewer_tasks(files: DataFrame, scans: int = 16) -> DataFrame:
    """The same files, many scan splits a task, as far as every core still has work.

    A split counts each file as 4 MB (spark.sql.files.openCostInBytes), so one of small
    files, or of names alone, ends after some 30, and starting its task takes longer.
    The number of tasks still grows with the number of files.
    """
    splits = files.rdd.getNumPartitions()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(-(-splits // scans), min(splits, 2 * cores), 1))


@contextmanager
def listings_dropped(spark: SparkSession) -> Iterator[None]:
    """Folders loaded inside are listed for their own scan alone, and the list goes with it."""
    before = spark.conf.get(LISTINGS)
    spark.conf.set(LISTINGS, "0")
    try:
        yield
    finally:
        spark.conf.set(LISTINGS, before)


def existing_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Paths of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    with listings_dropped(spark):
        files = reader.load(folder)
    return fewer_tasks(files.select(plain_path(F.col("path")).alias("path")))


def read_images(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Decoded images below a folder; an unreadable file has a negative height."""
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option(
        "ignoreMissingFiles", "true")
    with listings_dropped(spark):
        images = reader.load(folder)
    return flat_images(images).withColumn("path", plain_path(F.col("path")))


def _images_named(spark: SparkSession, part: DataFrame) -> DataFrame | None:
    """Decoded images of the paths of one slice; None if none of the files is there."""
    names = [row["path"] for row in part.collect()]
    try:
        return read_images(spark, [file_uri(name) for name in names]) if names else None
    except AnalysisException:  # some are not there
        folders = {name.rpartition("/")[0] or "/" for name in names}
        folders = [file_uri(f) for f in sorted(folders) if is_there(spark, f)]
        if not folders:
            return None
        found = existing_files(spark, folders).join(part, "path", "left_semi").collect()
        return read_images(spark, [file_uri(r["path"]) for r in found]) if found else None


def measured_files(paths: DataFrame, per_scan: int = FILES_PER_SCAN) -> DataFrame:
    """Metrics of the images with the given `path`s, one row for each distinct path.

    Only those files are opened. They are read in slices by a hash of the path; the driver
    names the files of one slice at a time, and Spark packs them into tasks by their bytes.
    A path without a file, or whose file goes meanwhile, is an invalid image, as one that
    cannot be decoded. Null paths are left out. Each slice is written before the next.
    """
    spark = paths.sparkSession
    known = cut(paths.select("path").filter("path is not null").distinct(), "paths")
    slices = -(-known.count() // per_scan) or 1
    target = scratch_path(spark, "metrics")
    invalid = {f.name: F.lit(_INVALID.get(f.name)).cast(f.dataType)
               for f in PHOTO_METRICS.fields if f.name != "path"}
    for at in range(slices):
        part = known.filter(F.pmod(F.xxhash64("path"), F.lit(slices)) == at)
        images = _images_named(spark, part)
        if images is None:
            rows = part.select("path", *[value.alias(name) for name, value in invalid.items()])
        else:
            found = part.join(photo_metrics(images), "path", "left")
            rows = found.select("path", *[
                F.when(F.col("valid").isNull(), value).otherwise(F.col(name)).alias(name)
                for name, value in invalid.items()])
        rows.write.mode("append").parquet(target)
    return spark.read.schema(PHOTO_METRICS).parquet(target)
