"""Declared amenities against amenities seen in photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.clean import strip
from hostlens.functions.display import amenity_title
from hostlens.functions.numeric import clamp, names_in
from hostlens.functions.similarity import labels_above, prompt_softmax
from hostlens.settings import AMENITY_ALIASES, AMENITY_LABELS, DEFAULTS, Settings

UNAVAILABLE = "Visual amenity detection unavailable; neutral score used"
NEUTRAL = 50.0


def amenity_key(word: Column) -> Column:
    """Canonical key of a lower-case amenity: two-way substring, first key wins."""
    key = F.when(F.lit(False), F.lit(""))
    for name, aliases in AMENITY_ALIASES.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | word.contains(alias) | F.lit(alias).contains(word)
        key = key.when(hit, name)
    return key


def declared_keys(amenities: Column) -> Column:
    """Sorted distinct keys of a list of free-text amenities."""
    words = F.transform(amenities, lambda item: strip(F.lower(item)))
    keys = F.transform(words, amenity_key)
    return F.array_sort(F.array_distinct(F.array_compact(keys)))


def with_detected(
    photos: DataFrame, embedding: str, prompts: list[list[float]], s: Settings = DEFAULTS
) -> DataFrame:
    """Add `amenity_mask`: the labels whose probability reaches the threshold."""
    seen = photos.withColumn("_p", prompt_softmax(prompts)(F.col(embedding)))
    mask = F.coalesce(
        labels_above(F.col("_p"), s.amenity_probability, AMENITY_LABELS), F.lit(0)
    )
    return seen.select(*photos.columns, mask.alias("amenity_mask"))


def amenity_aggregate() -> Column:
    """Union of the detected labels of a group, as one integer."""
    return F.bit_or("amenity_mask").alias("detected_mask")


def detected_keys(mask: Column) -> Column:
    return F.array_sort(names_in(mask, AMENITY_LABELS))


def cross_check(declared: Column, detected: Column) -> dict[str, Column]:
    """Matched, unconfirmed and undeclared keys; all sorted."""
    return {
        "matched": F.array_intersect(declared, detected),
        "unconfirmed": F.array_except(declared, detected),
        "undeclared": F.array_except(detected, declared),
    }


def amenity_score(s: Settings = DEFAULTS) -> Column:
    """Score from the columns of `cross_check` and the two key lists."""
    n_declared = F.size("declared").cast("double")
    n_undeclared = F.size("undeclared")
    share = F.size("matched").cast("double") / F.nullif(n_declared, F.lit(0.0))
    checked = (
        share * 100
        - F.size("unconfirmed") * s.unconfirmed_penalty * 10
        + F.least(n_undeclared * 3, F.lit(10))
    )
    return clamp(
        F.when((F.size("declared") == 0) & (F.size("detected") == 0), NEUTRAL)
        .when(F.size("declared") == 0, 70.0 + F.least(n_undeclared * 5, F.lit(20)))
        .otherwise(checked)
    )


def amenity_reasons() -> Column:
    def each(keys: str, text: str) -> Column:
        return F.transform(
            F.col(keys), lambda k: F.concat(amenity_title(k), F.lit(f" {text}"))
        )

    found = F.concat(
        each("matched", "detected and declared"),
        each("unconfirmed", "declared but not visually confirmed"),
        each("undeclared", "detected but not declared"),
    )
    return F.when(F.size(found) > 0, found).otherwise(
        F.array(F.lit("Amenity information available"))
    )


def with_amenity_check(rows: DataFrame, vision: bool, s: Settings = DEFAULTS) -> DataFrame:
    """Add the amenity result to rows with `declared, photo_count` (, `detected_mask`).

    Without vision the branch disappears from the plan and the score is neutral;
    a listing without photos is neutral as well.
    """
    empty = F.array().cast("array<string>")
    neutral_reason = F.array(F.lit(UNAVAILABLE))
    if not vision:
        return rows.select(
            "*", empty.alias("detected"), empty.alias("unconfirmed"),
            empty.alias("undeclared"), F.lit(NEUTRAL).alias("amenity_check"),
            neutral_reason.alias("amenity_reasons"),
        )
    usable = F.col("photo_count") > 0
    mask = F.when(usable, F.coalesce("detected_mask", F.lit(0))).otherwise(F.lit(0))
    seen = rows.withColumn("detected", detected_keys(mask))
    seen = seen.withColumns(cross_check(F.col("declared"), F.col("detected")))
    return seen.select(
        *rows.columns, "detected",
        F.when(usable, F.col("unconfirmed")).otherwise(empty).alias("unconfirmed"),
        "undeclared",
        F.when(usable, amenity_score(s)).otherwise(NEUTRAL).alias("amenity_check"),
        F.when(usable, amenity_reasons()).otherwise(neutral_reason).alias("amenity_reasons"),
    )
