"""Weighted total and plain-language explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions import explanation as ex
from hostlens.functions.display import room_phrase
from hostlens.functions.numeric import clamp, round_half_even
from hostlens.settings import COMPONENTS, DEFAULTS, Settings, check_weights

SHOWN_POSITIVE, SHOWN_ISSUES, SHOWN_SUGGESTIONS = 10, 10, 8

PHOTO_REASONS = ("technical_reasons", "aesthetic_reasons", "room_reasons", "amenity_reasons")


def with_quality_score(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Weighted sum of the six components, 0..100, two decimals."""
    check_weights(s.weights)
    total = sum((F.col(name) * float(s.weights[name]) for name in COMPONENTS), F.lit(0.0))
    return (
        rows.withColumn("_total", clamp(total / 100.0))
        .withColumn("quality_score", round_half_even(F.col("_total"), 2))
        .drop("_total")
    )


def photo_flag(s: Settings = DEFAULTS) -> Column:
    """Why a photo is flagged, in words; null when it is not."""
    guess = room_phrase(F.col("room"), F.col("room_confidence"), s)
    return (
        F.when(F.col("is_blurry"), F.concat(F.lit("Blurry photo; "), guess))
        .when(
            F.col("is_low_resolution"),
            F.concat(F.lit("Below configured resolution target; "), guess),
        )
    )


def flagged_rows(photos: DataFrame) -> DataFrame:
    """Flagged photos with what their reason is made of, shorter than the reason."""
    kept = [c for c in ("gallery", "entity_id", "seq", "row_key") if c in photos.columns]
    return photos.filter(F.col("is_blurry") | F.col("is_low_resolution")).select(
        *kept, "path", "width", "height", "is_blurry", "is_low_resolution", "room",
        "room_confidence",
    )


def flagged_photos(photos: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The long table of flagged photos, one row each, whole."""
    flagged = flagged_rows(photos)
    kept = [c for c in ("gallery", "entity_id", "seq", "row_key") if c in flagged.columns]
    return flagged.select(*kept, "path", photo_flag(s).alias("reason"), "width", "height")


def suggestions(all_issues: Column) -> Column:
    """Next steps; looks at the full issue list, before it is shortened."""
    blurry = F.when(F.col("blurry_count") > 0, F.array(F.concat(
        F.lit("Replace "), F.col("blurry_count").cast("string"), F.lit(" blurry photo(s)")
    ))).otherwise(F.array().cast("array<string>"))
    rooms = F.transform(
        "missing_rooms", lambda r: F.concat(F.lit("Add a clear "), r, F.lit(" photo"))
    )
    amenities = F.transform("undeclared", lambda a: F.concat(
        F.lit("Consider declaring the visually detected "),
        F.replace(a, F.lit("_"), F.lit(" ")),
    ))
    arabic = F.when(
        F.exists(all_issues, lambda i: F.lower(i).contains("arabic")),
        F.array(F.lit("Add an Arabic description")),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(blurry, rooms, amenities, arabic)


def with_explanation(rows: DataFrame) -> DataFrame:
    """Add the `explanation` struct from reason lists, room and amenity lists.

    `bad_photos` is taken over whole; the three text lists are shortened.
    """
    listed = rows.withColumn("_photo", F.concat(*[F.col(c) for c in PHOTO_REASONS]))
    listed = listed.withColumns({
        "_positive": F.concat(
            F.filter("_photo", ex.is_positive_reason),
            F.filter("text_reasons", lambda r: ~ex.is_text_issue(r)),
        ),
        "_issues": F.concat(
            F.filter("_photo", ex.is_issue_reason),
            F.filter("text_reasons", ex.is_text_issue),
            F.filter("completeness_reasons", lambda r: r.startswith("Missing")),
        ),
    })
    listed = listed.withColumn("_next", suggestions(F.col("_issues")))
    return listed.withColumn("explanation", F.struct(
        F.slice("_positive", 1, SHOWN_POSITIVE).alias("positive"),
        F.slice("_issues", 1, SHOWN_ISSUES).alias("issues"),
        F.slice("_next", 1, SHOWN_SUGGESTIONS).alias("suggestions"),
        F.col("bad_photos").alias("bad_photos"),
    )).drop("_photo", "_positive", "_issues", "_next")
