"""Linear calibration of the photo aesthetic score against human ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.clean import strip
from hostlens.functions.numeric import clamp
from hostlens.operators.validation import require_columns


def human_rating(ratings: DataFrame) -> Column:
    """The given average, else the mean of two raters, a missing one counting 0."""
    require_columns(ratings, ["photo_file"])
    if "avg_rating" in ratings.columns:
        return F.col("avg_rating").cast("double")
    require_columns(ratings, ["rater1", "rater2"])
    first, second = (
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("rater1", "rater2")
    )
    return (first + second) / 2


def rated_photos(ratings: DataFrame, photos: DataFrame) -> DataFrame:
    """(path, raw, human) of rated photos that exist (`path, aesthetic_raw`)."""
    rated = ratings.select(
        strip(F.col("photo_file")).alias("path"), human_rating(ratings).alias("human")
    ).filter(F.col("human").isNotNull() & ~F.isnan("human"))
    raw = photos.groupBy("path").agg(F.max("aesthetic_raw").alias("raw"))
    return rated.join(raw, "path").select("path", "raw", "human")


def fit_line(pairs: DataFrame, x: str = "raw", y: str = "human") -> DataFrame:
    """One row: least-squares slope and intercept, and the number of points.

    Fewer than two points give the identity; equal x values give a flat line
    through the mean.
    """
    sums = pairs.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.avg(y).alias("mean"), F.count(F.lit(1)).alias("points"),
    )
    enough = F.col("points") >= 2
    return sums.select(
        F.when(enough, F.coalesce("slope", F.lit(0.0))).otherwise(1.0).alias("slope"),
        F.when(enough, F.coalesce("intercept", "mean")).otherwise(0.0).alias("intercept"),
        "points",
    )


def apply_line(c: Column, slope: float, intercept: float) -> Column:
    return clamp(F.lit(slope) * c + F.lit(intercept))
