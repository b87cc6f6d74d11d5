"""Ranked report tables from a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.display import megapixel_text, score_bar, score_level
from hostlens.functions.explanation import from_json_cell
from hostlens.functions.numeric import round_half_even
from hostlens.operators.ordering import rank_all
from hostlens.settings import COMPONENTS


def report_totals(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("listings_scored"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("mean_score"),
    )


def first_rows(features: DataFrame, n: int = 20) -> DataFrame:
    return features.limit(n)


def by_score(features: DataFrame) -> DataFrame:
    """Best first; equal scores by id."""
    return features.orderBy(F.desc("quality_score"), "listing_id")


def ranked(features: DataFrame, top: int | None = None) -> DataFrame:
    """Report rows with their rank; only the best `top` when given."""
    shown = features.select(
        "listing_id", "quality_score", *COMPONENTS, "photo_status"
    )
    if top is not None:
        shown = by_score(shown).limit(top)
    placed = rank_all(shown, [F.desc("quality_score"), F.asc("listing_id")])
    one_decimal = {
        name: round_half_even(F.col(name), 1) for name in ("quality_score", *COMPONENTS)
    }
    level, bar = score_level(F.col("quality_score")), score_bar(F.col("quality_score"))
    return placed.withColumns({"level": level, "bar": bar}).withColumns(one_decimal)


def explanation_lists(features: DataFrame) -> DataFrame:
    """One row per listed strength, issue or next step, with its place in the list."""
    parsed = features.select("listing_id", from_json_cell(F.col("explanation_json")).alias("e"))
    labelled = F.array(*[
        F.struct(F.lit(section).alias("section"), F.col(f"e.{section}").alias("items"))
        for section in ("positive", "issues", "suggestions")
    ])
    return (
        parsed.select("listing_id", F.inline(labelled))
        .select("listing_id", "section", F.posexplode("items").alias("position", "item"))
    )


def photo_flags(features: DataFrame) -> DataFrame:
    """One row per flagged photo of the stored explanations.

    Cells without flags are dropped after the list is laid out: Spark would otherwise
    test the list beforehand, and write and parse the whole cell again for each test.
    """
    parsed = features.select("listing_id", from_json_cell(F.col("explanation_json")).alias("e"))
    marked = F.transform("e.bad_photos", lambda flag: F.struct(F.lit(True).alias("_there"), flag.alias("_flag")))
    flags = parsed.select("listing_id", F.inline_outer(marked)).filter("_there").select(
        "listing_id", "_flag.*")
    reason = F.replace("reason", F.lit("_"), F.lit(" "))
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    return flags.select(
        "listing_id", "path",
        F.when(sized, F.concat(
            reason, F.lit("; "), megapixel_text(F.col("width"), F.col("height"))
        )).otherwise(reason).alias("flag"),
    )
