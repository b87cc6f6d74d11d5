"""Room classification of photos and room coverage of galleries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.numeric import names_in
from hostlens.functions.similarity import prompt_softmax, top_label
from hostlens.settings import (
    ALWAYS_REQUIRED_ROOMS, DEFAULTS, EXPECTED_ROOMS, ROOM_KEYWORDS, ROOM_LABELS, Settings,
)

ALL_ROOMS = (1 << len(EXPECTED_ROOMS)) - 1


# outcome of the file-name rule -> (room, confidence); the last two are the
# "cover" hint and no hint at all
_NAMED = (*((room, 0.5) for _, room in ROOM_KEYWORDS), ("exterior", 0.4), ("other", 0.2))


def with_name_rule(photos: DataFrame, path: str = "path") -> DataFrame:
    """Add `_rule`, the number of the first keyword found in the file name.

    The cleaned name is its own projection: Spark then computes it once per row
    instead of once per keyword.
    """
    name = F.translate(F.lower(F.substring_index(path, "/", -1)), "_-", "  ")
    words = F.col("_words")
    rule = F.when(F.lit(False), F.lit(0))
    for i, (keyword, _) in enumerate(ROOM_KEYWORDS):
        rule = rule.when(words.contains(keyword), i)
    n = len(ROOM_KEYWORDS)
    rule = rule.when(words.contains("cover"), n).otherwise(n + 1)
    return photos.withColumn("_words", name).withColumn("_rule", rule).drop("_words")


def named_room(rule: Column) -> Column:
    return F.get(F.array(*[F.lit(room) for room, _ in _NAMED]), rule)


def named_confidence(rule: Column) -> Column:
    return F.get(F.array(*[F.lit(sure) for _, sure in _NAMED]), rule)


def with_room(
    photos: DataFrame, path: str = "path", embedding: str | None = None,
    prompts: list[list[float]] | None = None,
) -> DataFrame:
    """Add `room` and `room_confidence`.

    With an embedding column and one prompt vector per room label the highest
    probability decides; rows without a usable embedding, and all rows without
    prompts, fall back to the file name.
    """
    ruled = with_name_rule(photos, path)
    named, sure = named_room(F.col("_rule")), named_confidence(F.col("_rule"))
    if embedding is None or prompts is None:
        return ruled.select(
            *photos.columns, named.alias("room"), sure.alias("room_confidence")
        )
    seen = ruled.withColumn("_p", prompt_softmax(prompts)(F.col(embedding)))
    return seen.select(
        *photos.columns,
        F.coalesce(top_label(F.col("_p"), ROOM_LABELS), named).alias("room"),
        F.coalesce(F.array_max("_p"), sure).alias("room_confidence"),
    )


def join_predictions(photos: DataFrame, predictions: DataFrame) -> DataFrame:
    """Photos with the room of a predictions table (`path, room, room_confidence`).

    A photo without a prediction keeps null. The table is cut to one row per path
    first, so a path predicted twice does not double its photo.
    """
    best = predictions.groupBy("path").agg(
        F.max_by(F.struct("room", "room_confidence"), "room_confidence").alias("_best")
    )
    return photos.join(best, "path", "left").select(*photos.columns, "_best.*")


def room_bit(s: Settings = DEFAULTS) -> Column:
    """Bit of the room a photo covers; 0 below the confidence or outside the list."""
    bit = F.when(F.lit(False), F.lit(0))
    for i, room in enumerate(EXPECTED_ROOMS):
        bit = bit.when(F.col("room") == room, F.lit(1 << i))
    return F.when(F.col("room_confidence") >= s.room_confidence, bit.otherwise(0)).otherwise(0)


def room_aggregate(s: Settings = DEFAULTS) -> Column:
    """Covered rooms of a group as one integer: a label set without collecting."""
    return F.bit_or(room_bit(s)).alias("room_mask")


def required_rooms(bedrooms: int = 1) -> tuple[str, ...]:
    """A bedroom is required from one bedroom up; listings count at least one."""
    return tuple(
        room for room in EXPECTED_ROOMS
        if room in ALWAYS_REQUIRED_ROOMS or (room == "bedroom" and bedrooms >= 1)
    )


def coverage_columns(bedrooms: int = 1) -> dict[str, Column]:
    """Score, covered and missing rooms, and reasons from `room_mask, photo_count`."""
    required = required_rooms(bedrooms)
    some = F.col("photo_count") > 0
    mask = F.when(some, F.coalesce(F.col("room_mask"), F.lit(0))).otherwise(F.lit(0))
    wanted = sum(1 << EXPECTED_ROOMS.index(room) for room in required)
    hits = F.bit_count(mask.bitwiseAND(F.lit(wanted)))
    gaps = F.transform(
        F.filter(names_in(mask, EXPECTED_ROOMS, wanted=False), lambda r: r.isin(*required)),
        lambda r: F.concat(F.lit("No "), r, F.lit(" photo detected")),
    )
    reasons = (
        F.when(~some, F.array(F.lit("No photos for room coverage")))
        .when(F.size(gaps) > 0, gaps)
        .otherwise(F.array(F.lit("Good room coverage")))
    )
    return {
        "room_coverage": hits.cast("double") / len(required) * 100,
        "covered_rooms": F.array_sort(names_in(mask, EXPECTED_ROOMS)),
        "missing_rooms": names_in(mask, EXPECTED_ROOMS, wanted=False),
        "room_reasons": reasons,
    }
