"""Ranks and positions that never bring one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.operators.sizing import broadcast_if_small, lookup_side
from hostlens.session import cut


def _sorted_rows(df: DataFrame, order: list[Column], kept: list[str] | None = None,
                 light: bool = False) -> DataFrame:
    """Range-sorted rows with their partition and their place in it, written once.

    Only the `kept` columns are written after the sort, all by default.

    Writing fixes the partition borders for all readers. The order must end in a
    unique key: then range partitions stay balanced however many rows share the
    leading columns. The input is written first, since a range sort reads it
    twice: once to sample the borders, once to sort. A `light` input, wide but quickly
    made, is made twice instead.
    """
    kept = df.columns if kept is None else kept
    if not light:
        df = cut(df, "unsorted")
    serial = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("_serial", serial).select(
        *kept,
        F.shiftright("_serial", 33).alias("_part"),
        F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    return cut(placed, "sorted")


def rank_all(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table."""
    rows = _sorted_rows(df, order)
    # one row per partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_part").count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    ranked = rows.join(F.broadcast(starts), "_part")
    return ranked.withColumn(name, F.col("_start") + F.col("_place") + 1).drop(
        "_part", "_place", "_start"
    )


def position_in_group(
    df: DataFrame, group: str, order: list[Column], name: str = "position",
    kept: list[str] | None = None, light: bool = False,
) -> DataFrame:
    """1-based position inside a group, also for a group larger than one task.

    Columns that serve the order alone need not be written again: `kept` names those of
    the result, all by default. A `light` input is made twice, not written.
    """
    kept = df.columns if kept is None else kept
    rows = _sorted_rows(df, [F.col(group).asc(), *order], [group, *(c for c in kept if c != group)],
                        light)
    runs = rows.groupBy(group, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # a group has at most one run per partition of the sort
    earlier = (
        Window.partitionBy(group).orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # written, so that a counted small table of runs travels and the rows stay in place
    runs = cut(runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "runs")
    placed = rows.join(broadcast_if_small(runs), [group, "_part"])
    return placed.withColumn(
        name, F.col("_place") - F.col("_first") + F.col("_before") + 1
    ).drop("_part", "_place", "_first", "_n", "_before")


def position_by_section(
    df: DataFrame, group: str, section: str, starts: DataFrame, order: list[Column],
    name: str = "position", kept: list[str] | None = None, groups: DataFrame | None = None,
) -> DataFrame:
    """1-based position inside a group whose sections follow each other whole.

    `starts` says where a section comes, by its columns beside `section`, which differ
    between the sections of a group; sections without a start are left out, and groups
    that are not among `groups`, if given. Rows are sorted by the section itself, and only
    counted runs of rows meet `starts` and `groups`, not the rows before their sort.
    """
    kept = df.columns if kept is None else kept
    keys = [group, section]
    rows = _sorted_rows(df, [F.col(group).asc(), F.col(section).asc(), *order],
                        [*keys, *(c for c in kept if c not in keys)], light=True)
    runs = rows.groupBy(*keys, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    places = [c for c in starts.columns if c != section]
    met = runs.join(starts, section)
    if groups is not None:
        met = met.join(lookup_side(groups), group, "left_semi")
    earlier = (
        Window.partitionBy(group).orderBy(*places, section, "_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = cut(met.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *keys, "_part", "_first", "_before"), "runs")
    placed = rows.join(broadcast_if_small(runs), [*keys, "_part"])
    return placed.select(*kept, (
        F.col("_place") - F.col("_first") + F.col("_before") + 1).alias(name))
