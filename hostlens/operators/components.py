"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.session import cut, is_empty


def _toward_min(pairs: DataFrame, key: str) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = pairs.unionByName(
        pairs.select(key, F.col("v").alias("u"), F.col("u").alias("v"))
    )
    lowest = both.groupBy(key, "u").agg(F.min("v").alias("low")).withColumn(
        "low", F.least("low", "u")
    )
    linked = both.filter(F.col("v") > F.col("u")).join(lowest, [key, "u"])
    return linked.select(key, F.col("low").alias("u"), "v").distinct()


def _lower_side(pairs: DataFrame, key: str) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to their smallest."""
    lowest = pairs.groupBy(key, "v").agg(F.min("u").alias("low"))
    linked = pairs.join(lowest, [key, "v"])
    moved = linked.filter(F.col("u") != F.col("low")).select(
        key, F.col("low").alias("u"), F.col("u").alias("v")
    )
    kept = lowest.select(key, F.col("low").alias("u"), "v")
    return moved.unionByName(kept).distinct()


def _is_star_forest(stars: DataFrame, key: str) -> bool:
    """Whether every node is either a centre or the leaf of one centre."""
    ends = stars.select(key, F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")),
    )))
    nodes = ends.groupBy(key, "node").agg(
        F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")
    )
    return is_empty(nodes.filter(F.col("centre") + F.col("leaf") > 1))


def component_roots(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, root) for every node that has an edge; root is the smallest node.

    `edges` has the columns key, u, v; edges connect nodes of equal key only.
    Each round is two joins on (key, node) with map-side minimums; the rounds
    grow with the logarithm of the longest chain. AQE splits hot star centres.
    """
    stars = cut(
        edges.select(
            key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        ).filter("u <> v").distinct()
    )

    while not _is_star_forest(stars, key):
        stars = cut(_lower_side(_toward_min(stars, key), key))
    roots = stars.select(key, F.col("v").alias("node"), F.col("u").alias("root"))
    centres = stars.select(key, F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return roots.unionByName(centres)
