"""Dataset profile as one long table (section, metric, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.session import cut

_ROW = ("section", "metric", "key", "value")


def _unpivot(one_row: DataFrame, section: str, entries: list[tuple[str, str, str]]) -> DataFrame:
    """(metric, key, column) entries of a one-row frame as long rows."""
    structs = [
        F.struct(
            F.lit(section).alias("section"), F.lit(metric).alias("metric"),
            F.lit(key).alias("key"), F.col(column).cast("double").alias("value"),
        )
        for metric, key, column in entries
    ]
    return one_row.select(F.inline(F.array(*structs)))


def is_stay(listings: DataFrame) -> Column:
    """Exactly "stay"; every row when the column is absent."""
    if "vertical" not in listings.columns:
        return F.lit(True)
    return F.coalesce(F.col("vertical") == "stay", F.lit(False))


def city_counts(listings: DataFrame) -> DataFrame:
    """Every count of the profile by city, which are far fewer than listings: one scan.

    (city, rows, stay, amenities, null_0, ...); the nulls by the order of the columns.
    """
    names = [c for c in listings.columns if c != "row_key"]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(names)]
    return listings.groupBy("city").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_stay(listings)).alias("stay"),
        F.count("amenities").alias("amenities"), *nulls)


def listing_counts(listings: DataFrame, by_city: DataFrame | None = None) -> DataFrame:
    """Rows, stay rows, cities, amenity cells and nulls per column, in one pass.

    `by_city` are the `city_counts` of the listings, when they are made already.
    """
    names = [c for c in listings.columns if c != "row_key"]
    found = city_counts(listings) if by_city is None else by_city
    sums = ["rows", "stay", "amenities", *(f"null_{i}" for i, _ in enumerate(names))]
    counts = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
                       F.count("city").alias("cities"))
    entries = [
        ("total rows", "", "rows"), ("stay listings", "", "stay"),
        ("unique cities", "", "cities"), ("with amenities", "", "amenities"),
        *[("missing values", c, f"null_{i}") for i, c in enumerate(names)],
    ]
    return _unpivot(counts, "listings", entries).filter(
        (F.col("metric") != "missing values") | (F.col("value") > 0)
    )


def column_list(listings: DataFrame) -> DataFrame:
    """Column names with their position, from the schema alone."""
    names = [c for c in listings.columns if c != "row_key"]
    rows = F.array(*[
        F.struct(F.lit("listings").alias("section"), F.lit("column").alias("metric"),
                 F.lit(c).alias("key"), F.lit(float(i)).alias("value"))
        for i, c in enumerate(names)
    ])
    return listings.sparkSession.range(1).select(F.inline(rows))


def top_cities(listings: DataFrame, n: int = 5, by_city: DataFrame | None = None) -> DataFrame:
    """The cities with most listings; `by_city` as in `listing_counts`."""
    found = listings.groupBy("city").agg(
        F.count(F.lit(1)).alias("rows")) if by_city is None else by_city
    counted = found.filter(F.col("city").isNotNull()).orderBy(F.desc("rows"), "city").limit(n)
    return counted.select(
        F.lit("listings").alias("section"), F.lit("top city").alias("metric"),
        F.col("city").alias("key"), F.col("rows").cast("double").alias("value"),
    )


def photo_counts(photos: DataFrame) -> DataFrame:
    """Rows, entities and the mean number of photos per entity."""
    per_entity = photos.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("entity_id").isNotNull()
    counts = per_entity.agg(
        F.sum("n").alias("rows"), F.count_if(named).alias("entities"),
        F.avg(F.when(named, F.col("n"))).alias("mean"),
    )
    return _unpivot(counts, "photos", [
        ("rows", "", "rows"), ("entities", "", "entities"), ("photos per entity", "", "mean"),
    ])


def city_reference(cities: DataFrame) -> DataFrame:
    return _unpivot(
        cities.agg(F.count(F.lit(1)).alias("n")), "cities", [("reference cities", "", "n")]
    )


def data_profile(listings: DataFrame, photos: DataFrame, cities: DataFrame) -> DataFrame:
    """The whole profile; each input is scanned once."""
    by_city = cut(city_counts(listings), "city-counts")
    parts = [
        listing_counts(listings, by_city), column_list(listings),
        top_cities(listings, by_city=by_city),
        photo_counts(photos), city_reference(cities),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(*_ROW)
