"""Scans of listings, photos, labels, ratings and the city table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.clean import CONVERTERS, TYPES, missing_to_null, number, strip
from hostlens.operators.validation import require_columns
from hostlens.schemas import LISTING_FIELDS, PHOTO_FIELDS
from hostlens.session import cut
from hostlens.sources.records import read_split_csv


def row_key() -> Column:
    """Orders rows by file name, then by place in the file."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("serial"),
    )


def _named(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_cells(spark: SparkSession, path: str, fmt: str = "csv",
               multiline: bool = True, split: bool = True) -> DataFrame:
    """A raw table with its `row_key`; every CSV cell stays text, missing ones null.

    `multiline` is needed when cells contain line breaks, as descriptions do. A file is
    split among tasks all the same (`sources.records`), written once as Parquet and read from
    there, unless `split` is off: then one task reads a file. That also takes quotes that
    neither enclose a cell nor are doubled in one, which the split reader refuses.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, multiLine=multiline, escape='"')
        cells = [missing_to_null(_named(c)).alias(c) for c in raw.columns]
        if multiline and split:
            raw = read_split_csv(spark, path, raw.columns)
            return cut(raw.select(*cells, "row_key"), "cells")
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
        cells = [_named(c) for c in raw.columns]
    else:
        raise ValueError(f"unknown table format: {fmt}")
    return raw.select(*cells, row_key().alias("row_key"))


def typed(raw: DataFrame, fields: dict[str, str], strict: bool = True) -> DataFrame:
    """Clean raw cells into the given fields; absent columns get their default."""
    def convert(name: str, kind: str) -> Column:
        if name not in raw.columns:
            return CONVERTERS[kind](F.lit(None).cast("string"), strict)
        source = dict(raw.dtypes)[name]
        if source == TYPES[kind]:
            if kind == "text":
                return CONVERTERS[kind](missing_to_null(F.col(name)), strict)
            default = CONVERTERS[kind](F.lit(None).cast("string"), strict)
            return F.coalesce(F.col(name), default)
        text = missing_to_null(F.col(name).cast("string"))
        return CONVERTERS[kind](text, strict)

    columns = [convert(name, kind).alias(name) for name, kind in fields.items()]
    kept = [F.col("row_key")] if "row_key" in raw.columns else []
    return raw.select(*columns, *kept)


def clean_listings(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed listings with a nonblank id."""
    rows = typed(raw, LISTING_FIELDS, strict)
    return rows.withColumn("listing_id", strip(F.col("listing_id"))).filter(
        F.col("listing_id") != ""
    )


def clean_photos(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed photo records with a nonblank entity and file."""
    rows = typed(raw, PHOTO_FIELDS, strict)
    rows = rows.withColumns(
        {"entity_id": strip(F.col("entity_id")), "file": strip(F.col("file"))}
    )
    return rows.filter((F.col("entity_id") != "") & (F.col("file") != ""))


def read_listings(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True,
                  split: bool = True):
    return clean_listings(read_cells(spark, path, fmt, split=split), strict)


def read_photos(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True,
                multiline: bool = False):
    return clean_photos(read_cells(spark, path, fmt, multiline), strict)


def read_labels(spark: SparkSession, path: str, fmt: str = "csv",
                multiline: bool = False) -> DataFrame:
    """Labelled photos: `photo_file, label`."""
    raw = read_cells(spark, path, fmt, multiline)
    require_columns(raw, ["photo_file", "label"])
    return raw.select("photo_file", "label")


def read_ratings(spark: SparkSession, path: str, fmt: str = "csv",
                 multiline: bool = False) -> DataFrame:
    """Rated photos: `photo_file` with `avg_rating`, or with `rater1, rater2`."""
    raw = read_cells(spark, path, fmt, multiline)
    require_columns(raw, ["photo_file"])
    if "avg_rating" in raw.columns:
        return raw.select("photo_file", number(F.col("avg_rating")).alias("avg_rating"))
    require_columns(raw, ["rater1", "rater2"])
    return raw.select(
        "photo_file", number(F.col("rater1")).alias("rater1"), number(F.col("rater2")).alias("rater2")
    )


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return read_cells(spark, path).drop("row_key")


def first_listings(listings: DataFrame, n: int) -> DataFrame:
    """The first n listings in input order."""
    if n < 0:
        raise ValueError("limit must not be negative")
    return listings.orderBy("row_key").limit(n)


def eligible(listings: DataFrame) -> DataFrame:
    """Listings without a vertical, or with exactly "stay"."""
    return listings.filter(F.col("vertical").isin("", "stay"))
