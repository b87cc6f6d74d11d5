"""Contract checks of a finished feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.clean import number, strip
from hostlens.functions.explanation import is_valid_cell
from hostlens.settings import COMPONENTS, DEFAULTS, FEATURE_COLUMNS, Settings, check_weights

COUNTS = (
    "listing_id_missing", "duplicate_listing_ids", "quality_score_out_of_range",
    "component_scores_out_of_range", "non_finite_component_scores",
    "non_finite_quality_scores", "invalid_explanation_json",
)


def require_columns(df: DataFrame, names) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")


def to_number(c: Column) -> Column:
    """A number, or NaN for anything that is not one."""
    return F.coalesce(number(c.cast("string")), F.lit(float("nan")))


def out_of_range(c: Column) -> Column:
    # NaN sorts above every number in Spark but is not out of range
    return ~F.isnan(c) & ((c < 0) | (c > 100))


def non_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def validate_features(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: row count, seven defect counts, and whether the table passes."""
    require_columns(df, FEATURE_COLUMNS)
    check_weights(s.weights)
    listing_id = strip(F.col("listing_id").cast("string"))
    numbers = df.select(
        F.when(listing_id != "", listing_id).alias("id"),
        to_number(F.col("quality_score")).alias("quality_score"),
        *[to_number(F.col(name)).alias(name) for name in COMPONENTS],
        is_valid_cell(F.col("explanation_json")).alias("valid_json"),
    )

    def over_components(test) -> Column:
        return sum((F.count_if(test(F.col(name))) for name in COMPONENTS), F.lit(0))

    counts = numbers.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("id").isNull()).alias("listing_id_missing"),
        (F.count("id") - F.countDistinct("id")).alias("duplicate_listing_ids"),
        F.count_if(out_of_range(F.col("quality_score"))).alias("quality_score_out_of_range"),
        over_components(out_of_range).alias("component_scores_out_of_range"),
        over_components(non_finite).alias("non_finite_component_scores"),
        F.count_if(non_finite(F.col("quality_score"))).alias("non_finite_quality_scores"),
        F.count_if(~F.col("valid_json")).alias("invalid_explanation_json"),
    )
    clean = F.col("row_count") > 0
    for name in COUNTS:
        clean = clean & (F.col(name) == 0)
    return counts.withColumn("passes", clean)
