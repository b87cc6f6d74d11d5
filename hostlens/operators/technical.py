"""Technical and aesthetic photo quality, per photo and per gallery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.numeric import clamp, normalise
from hostlens.settings import DEFAULTS, Settings

NO_PHOTOS = "No photos available"
NO_VALID_PHOTOS = "No valid photos could be processed"


def exposure_score(brightness: Column, s: Settings = DEFAULTS) -> Column:
    return (
        F.when(brightness < s.dark_threshold, normalise(brightness, 0.0, s.dark_threshold))
        .when(
            brightness > s.bright_threshold,
            normalise(255.0 - brightness, 0.0, 255.0 - s.bright_threshold),
        )
        .otherwise(100.0)
    )


def resolution_score(width: Column, height: Column, s: Settings = DEFAULTS) -> Column:
    megapixels = width.cast("double") * height.cast("double") / 1_000_000.0
    return normalise(megapixels, s.min_megapixels, s.good_megapixels)


def aesthetic_raw(
    valid: Column, sharpness: Column, colorfulness: Column, contrast: Column
) -> Column:
    """Colour, contrast and sharpness blend, 0..100; an invalid photo counts as 0."""
    def share(c: Column, full: float) -> Column:
        return F.least(c / full, F.lit(1.0))

    blend = (
        0.35 * share(colorfulness, 40.0) + 0.35 * share(contrast, 60.0)
        + 0.30 * share(sharpness, 150.0)
    )
    return F.when(valid, clamp(blend * 100)).otherwise(0.0)


def with_photo_scores(photos: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Add the per-photo scores and flags to rows that carry the raw metrics."""
    return photos.select(
        "*",
        exposure_score(F.col("brightness"), s).alias("exposure_score"),
        resolution_score(F.col("width"), F.col("height"), s).alias("resolution_score"),
        (F.col("valid") & (F.col("sharpness") < s.blurry_threshold)).alias("is_blurry"),
        aesthetic_raw(
            F.col("valid"), F.col("sharpness"), F.col("colorfulness"), F.col("contrast")
        ).alias("aesthetic_raw"),
    ).withColumn(
        "is_low_resolution",
        F.col("valid") & (F.col("resolution_score") < s.low_resolution_score),
    )


def technical_aggregates() -> list[Column]:
    """Fixed-width sums per gallery: they combine on the map side."""
    valid = F.col("valid")
    return [
        F.count(F.lit(1)).alias("photo_count"),
        F.count_if(valid).alias("valid_count"),
        F.count_if(F.col("is_blurry")).alias("blurry_count"),
        F.count_if(F.col("is_low_resolution")).alias("low_resolution_count"),
        F.avg(F.when(valid, F.col("sharpness"))).alias("avg_sharpness"),
        F.avg(F.when(valid, F.col("exposure_score"))).alias("avg_exposure"),
        F.avg(F.when(valid, F.col("resolution_score"))).alias("avg_resolution"),
        F.avg(F.col("aesthetic_raw")).alias("avg_aesthetic"),
    ]


def technical_score(s: Settings = DEFAULTS) -> Column:
    penalty = F.least(F.col("duplicate_groups") * 8, F.lit(25)).cast("double")
    blend = (
        0.35 * normalise(F.col("avg_sharpness"), s.blurry_threshold, s.sharp_threshold)
        + 0.25 * F.col("avg_exposure") + 0.25 * F.col("avg_resolution")
    )
    return F.when(F.col("valid_count") > 0, clamp(blend - penalty)).otherwise(0.0)


def technical_reasons() -> Column:
    def counted(count: str, text: str) -> Column:
        return F.when(
            F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(f" {text}"))
        )

    found = F.array_compact(F.array(
        counted("blurry_count", "blurry photo(s)"),
        counted("duplicate_groups", "near-duplicate photo group(s)"),
        counted("low_resolution_count", "low-resolution photo(s)"),
    ))
    usual = F.when(F.size(found) > 0, found).otherwise(
        F.array(F.lit("Good technical photo quality"))
    )
    return (
        F.when(F.col("photo_count") == 0, F.array(F.lit(NO_PHOTOS)))
        .when(F.col("valid_count") == 0, F.array(F.lit(NO_VALID_PHOTOS)))
        .otherwise(usual)
    )


def aesthetic_score(calibrator: tuple[float, float] | None = None) -> Column:
    """Mean over all photos; a fitted line is applied to the mean when given."""
    mean = F.col("avg_aesthetic")
    if calibrator is not None:
        slope, intercept = calibrator
        mean = clamp(F.lit(slope) * mean + F.lit(intercept))
    return F.when(F.col("photo_count") > 0, mean).otherwise(0.0)


def aesthetic_reasons(score: Column) -> Column:
    return F.array(
        F.when(F.col("photo_count") == 0, F.lit("No photos for aesthetic scoring"))
        .when(score >= 65, F.lit("Good composition and lighting"))
        .otherwise(F.lit("Photo aesthetics could be improved"))
    )


def with_duplicate_groups(stats: DataFrame, duplicates: DataFrame | None) -> DataFrame:
    """Join the cluster counts; a gallery without a valid photo has none."""
    if duplicates is None:
        return stats.withColumn("duplicate_groups", F.lit(0).cast("bigint"))
    counted = F.when(F.col("valid_count") > 0, F.coalesce("duplicate_groups", F.lit(0)))
    return stats.join(duplicates, "gallery", "left").withColumn(
        "duplicate_groups", counted.otherwise(0).cast("bigint")
    )


def score_galleries(photos: DataFrame, duplicates: DataFrame | None = None,
                    s: Settings = DEFAULTS) -> DataFrame:
    """Technical and aesthetic results per gallery from scored photo rows."""
    stats = photos.groupBy("gallery").agg(*technical_aggregates())
    return with_duplicate_groups(stats, duplicates).select(
        "*", technical_score(s).alias("photo_technical"),
        technical_reasons().alias("technical_reasons"),
    )
