"""Numeric helpers shared by the scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normalise(c: Column, low: float, high: float) -> Column:
    """Linear position between low and high, as 0..100; 0 for an empty interval."""
    if high <= low:
        return F.lit(0.0)
    return clamp((c - F.lit(low)) / F.lit(high - low), 0.0, 1.0) * 100


def round_half_even(c: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    Spark's round() works on the shortest decimal spelling, so 2.675 becomes
    2.68 although the stored value lies below 2.675. Splitting the value in two
    halves of 26 bits makes the comparison with the midpoint exact.
    """
    scale = float(10**digits)
    below = F.floor(c * scale)
    midpoint = (below * 2 + 1).cast("double")
    high = c * 134217729.0 - (c * 134217729.0 - c)
    gap = (high * (2 * scale) - midpoint) + (c - high) * (2 * scale)
    chosen = (
        F.when(gap > 0, below + 1)
        .when(gap < 0, below)
        .otherwise(below + F.pmod(below, F.lit(2)))
    )
    return chosen.cast("double") / scale


def percent_text(c: Column) -> Column:
    """0.285 -> '28%': whole percent, ties to even."""
    return F.concat(F.rint(c * 100).cast("bigint").cast("string"), F.lit("%"))


def mask_of(names: Column, labels: tuple[str, ...]) -> Column:
    """Bit mask of the labels that occur in an array column."""
    bits = [
        F.when(F.array_contains(names, label), F.lit(1 << i)).otherwise(F.lit(0))
        for i, label in enumerate(labels)
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total


def names_in(mask: Column, labels: tuple[str, ...], wanted: bool = True) -> Column:
    """The labels whose bit is set (or not set), in the given order."""
    picked = [
        F.when((mask.bitwiseAND(F.lit(1 << i)) != 0) == F.lit(wanted), F.lit(label))
        for i, label in enumerate(labels)
    ]
    return F.array_compact(F.array(*picked))
