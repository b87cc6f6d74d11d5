"""Readable texts: levels, bars, sizes, room and amenity names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens.functions.numeric import clamp, percent_text, round_half_even
from hostlens.settings import DEFAULTS, EXPECTED_ROOMS, Settings


def score_level(score: Column) -> Column:
    return (
        F.when(score >= 80, "EXCELLENT")
        .when(score >= 65, "GOOD")
        .when(score >= 50, "NEEDS WORK")
        .otherwise("LOW")
    )


def score_bar(score: Column, width: int = 20) -> Column:
    filled = F.rint(clamp(score) / 100 * width).cast("int")
    return F.concat(
        F.lit("["), F.repeat(F.lit("#"), filled),
        F.repeat(F.lit("."), F.lit(width) - filled), F.lit("]"),
    )


def megapixel_text(width: Column, height: Column) -> Column:
    area = width.cast("double") * height.cast("double") / 1_000_000.0
    return F.concat(
        width.cast("string"), F.lit(" x "), height.cast("string"), F.lit(" px ("),
        F.format_string("%.2f", round_half_even(area, 2)), F.lit(" MP)"),
    )


def amenity_title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def room_phrase(label: Column, confidence: Column, s: Settings = DEFAULTS) -> Column:
    """The room guess in words; null label means there was no guess."""
    shown = F.when(label == "living", F.lit("living room")).otherwise(
        F.replace(label, F.lit("_"), F.lit(" "))
    )
    known = (confidence >= s.room_confidence) & label.isin(*EXPECTED_ROOMS)
    sure = percent_text(confidence)
    return (
        F.when(label.isNull(), F.lit("room guess unavailable"))
        .when(known, F.concat(
            F.lit("room guess: "), shown, F.lit(" ("), sure,
            F.lit(" classifier confidence)"),
        ))
        .otherwise(F.concat(
            F.lit("room guess: unknown room (top guess "), shown, F.lit(", "), sure,
            F.lit(" classifier confidence)"),
        ))
    )
