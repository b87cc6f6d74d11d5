"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.session import shuffles_removed

# a broadcast table may hold this many short keys (about 10 MB)
BROADCAST_KEYS = 200_000


def broadcast_if_small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Mark a table of short keys for broadcast after counting it.

    The count stops at the bound. A larger table keeps its plain shuffle join.
    """
    with shuffles_removed(keys.sparkSession):
        few = keys.limit(most + 1).count() <= most
    return F.broadcast(keys) if few else keys


def lookup_side(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Distinct short keys, counted, as the right side of a semi join.

    Beyond the bound of a broadcast they are hashed share by share, so the rows that are
    looked up, far more of them and wider, are shuffled but not sorted.
    """
    found = broadcast_if_small(keys, most)
    return keys.hint("shuffle_hash") if found is keys else found
