"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.session import cut


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("a"), F.col("b")),
                                         F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def linked_roots(links: DataFrame, name: str = "roots") -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the smallest node it reaches.

    Each round turns the links round their smallest ends. First, every node hands the larger
    of its neighbours to the smallest of all, itself included; then, the smaller of its
    neighbours. What is left at the end are links between roots and nodes. Links halve their
    distance to the root, so rounds grow with the logarithm of the longest chain. Minimums
    are taken before the shuffle, and a node with very many links is split by the join.
    """
    links = cut(links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    while True:
        around = _both_ways(links)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        turned = around.filter("b > a").join(least, "a").select(
            F.col("low").alias("a"), "b").filter("a <> b").distinct()
        turned = cut(turned, name)
        below = turned.groupBy("b").agg(F.min("a").alias("low"), F.count(F.lit(1)).alias("n"))
        moved = turned.join(below, "b").filter("a <> low").select(
            F.col("low").alias("a"), F.col("a").alias("b"))
        kept = below.select(F.col("low").alias("a"), "b")
        links = cut(kept.unionByName(moved).distinct(), name)
        # done when no node has two smaller neighbours and no root hangs from another
        several = links.groupBy("b").count().filter("count > 1")
        hanging = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if several.isEmpty() and hanging.isEmpty():
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
