"""Scores a listing gets from its own row: text quality and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions import text as tx
from hostlens.functions.clean import strip
from hostlens.settings import DEFAULTS, Settings

# --- fixed values: order and names of the completeness checks ---
CHECKS = (
    "title", "description", "amenities", "capacity", "bedrooms", "price", "city",
    "photos", "calendar", "instant_book", "ical",
)
# --- end of fixed values ---
SHOWN_FILLED = 5


def text_measures(listings: DataFrame) -> DataFrame:
    """Add word count, title length and the three language markers.

    Title and text are measured apart: a line break stands between them, so no
    word and no marker can span both, and the long text is not copied.
    """
    title, body = F.col("name"), F.col("description")
    return listings.withColumns({
        "word_count": tx.word_count(title) + tx.word_count(body),
        "title_length": F.length(strip(title)),
        "arabic": tx.has_arabic(title) | tx.has_arabic(body),
        "french": tx.has_french(title) | tx.has_french(body),
        "english": tx.has_english(title) | tx.has_english(body),
    })


def text_score(s: Settings = DEFAULTS) -> Column:
    found = sum((F.col(lang).cast("int") for lang in tx.LANGUAGES), F.lit(0))
    return (
        0.4 * (found.cast("double") / 3 * 100)
        + 0.4 * tx.length_score(F.col("word_count"), s)
        + 0.2 * tx.title_score(F.col("title_length"), s)
    )


def text_reasons(s: Settings = DEFAULTS) -> Column:
    words, title = F.col("word_count"), F.col("title_length")
    spoken = [
        F.when(F.col(lang), F.lit(f"{lang.capitalize()} content detected"))
        .otherwise(F.lit(f"{lang.capitalize()} description missing"))
        for lang in tx.LANGUAGES
    ]
    length = (
        F.when(words >= s.good_description_words, "Good description length")
        .when(words >= s.min_description_words, "Description length is moderate")
        .otherwise("Description is too short")
    )
    heading = (
        F.when(title == 0, "Title is empty")
        .when(title < s.min_title_length, "Title is very short")
    )
    return F.array_compact(F.array(*spoken, length, heading))


def with_text_quality(listings: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return text_measures(listings).withColumns(
        {"text_quality": text_score(s), "text_reasons": text_reasons(s)}
    )


def completeness_checks(s: Settings = DEFAULTS) -> Column:
    """Ordered array of (name, ok)."""
    tests = (
        tx.has_content(F.col("name")),
        tx.has_content(F.col("description")),
        F.size("amenities") > 0,
        F.col("capacity") > 0,
        F.col("bedrooms") > 0,
        F.col("base_price") > 0,
        F.col("city") != "",
        F.col("photo_count") > 0,
        F.col("pricing_days_180") >= s.min_calendar_days,
        F.col("instant_booking"),
        F.col("has_active_ical") | F.col("is_calendar_synced"),
    )
    return F.array(*[
        F.struct(F.lit(name).alias("name"), test.alias("ok"))
        for name, test in zip(CHECKS, tests, strict=True)
    ])


def with_completeness(listings: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Add score, filled and missing field names, and reasons."""
    checked = listings.withColumn("_checks", completeness_checks(s))
    named = checked.withColumns({
        "filled_fields": F.transform(
            F.filter("_checks", lambda c: c["ok"]), lambda c: c["name"]
        ),
        "missing_fields": F.transform(
            F.filter("_checks", lambda c: ~c["ok"]), lambda c: c["name"]
        ),
    }).drop("_checks")
    present = F.transform(
        F.slice("filled_fields", 1, SHOWN_FILLED), lambda f: F.concat(f, F.lit(" present"))
    )
    weak = F.transform("missing_fields", lambda f: F.concat(
        F.lit("Missing or weak: "), F.replace(f, F.lit("_"), F.lit(" "))
    ))
    return named.withColumns({
        "completeness": F.size("filled_fields").cast("double") / len(CHECKS) * 100,
        "completeness_reasons": F.concat(present, weak),
    })
