"""Near-duplicate photos: perceptual hashes within a small Hamming distance.

Equal hashes are collapsed before anything is compared, so copies cost nothing.
Distinct hashes of one gallery are compared in *buckets*. A whole gallery is one
bucket while it is small. A larger one is split by hash bits: the bits not used
yet are cut into `threshold + 1` bands, and two hashes within the threshold agree
in at least one band, so every close pair meets again in a smaller bucket. Bits
are added until each bucket is small; nothing is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.similarity import hamming
from hostlens.operators.components import component_roots
from hostlens.operators.sizing import broadcast_if_small
from hostlens.session import cut, is_empty

BUCKET_ROWS = 1024
HASH_BITS = 64
# split levels: as many as keep the table of bit masks short
MOST_MASKS = 1500
_BUCKET = ["gallery", "path", "bits"]


def distinct_hashes(members: DataFrame) -> DataFrame:
    """(gallery, phash, copies); photos without a hash take no part."""
    return (
        members.filter(F.col("phash").isNotNull())
        .groupBy("gallery", "phash")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _signed(mask: int) -> int:
    return mask - (1 << HASH_BITS) if mask >> (HASH_BITS - 1) else mask


def _bands(used: int, parts: int) -> list[int]:
    """Cut the unused bit positions into contiguous bands; each band as a mask."""
    free = [i for i in range(HASH_BITS) if not used >> i & 1]
    borders = [len(free) * k // parts for k in range(parts + 1)]
    return [
        sum(1 << i for i in free[a:b]) for a, b in zip(borders, borders[1:], strict=False)
    ]


def _split_masks(level: int, parts: int) -> list[list[int]]:
    """For each path of the previous level, the bit masks its children compare."""
    paths = [0]
    for _ in range(level):
        children = [[used | band for band in _bands(used, parts)] for used in paths]
        paths = [mask for group in children for mask in group]
    return children


def _close(threshold: int) -> Column:
    return (F.col("a.phash") < F.col("b.phash")) & (
        hamming(F.col("a.phash"), F.col("b.phash")) <= threshold
    )


def _edges_inside(rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Close pairs inside buckets of bounded size; only true pairs leave the join."""
    joined = rows.alias("a").join(
        rows.alias("b"),
        [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [condition],
    )
    return joined.select(
        F.col("a.gallery").alias("gallery"),
        F.col("a.phash").alias("u"), F.col("b.phash").alias("v"),
    )


def _window_edges(rows: DataFrame, threshold: int) -> DataFrame:
    """Hashes that differ only inside one window of `threshold` bits: always close.

    Such a group has at most 2**window members (window capped at 10 bits), so a
    window function over it is bounded; each member links to the smallest.
    """
    width = max(1, min(threshold, 10))
    masks = [
        ((1 << width) - 1) << start & (1 << HASH_BITS) - 1
        for start in range(0, HASH_BITS, width)
    ]
    windows = F.array(*[F.lit(_signed(~m & (1 << HASH_BITS) - 1)) for m in masks])
    rest = (
        rows.select("gallery", "phash", F.posexplode(windows).alias("slot", "mask"))
        .withColumn("rest", F.col("phash").bitwiseAND(F.col("mask")))
    )
    same = Window.partitionBy("gallery", "slot", "rest")
    return (
        rest.withColumn("u", F.min("phash").over(same))
        .filter(F.col("u") < F.col("phash"))
        .select("gallery", "u", F.col("phash").alias("v"))
    )


def _hub_edges(rows: DataFrame, threshold: int) -> DataFrame:
    """Links to the most copied hash of each gallery, where close."""
    hubs = rows.groupBy("gallery").agg(
        F.max(F.struct("copies", "phash"))["phash"].alias("hub")
    )
    near = rows.join(broadcast_if_small(hubs), "gallery").filter(
        (F.col("phash") != F.col("hub")) & (hamming(F.col("phash"), F.col("hub")) <= threshold)
    )
    return near.select(
        "gallery", F.least("phash", "hub").alias("u"), F.greatest("phash", "hub").alias("v")
    )


def _block_edges(rows: DataFrame, sizes: DataFrame, keys: list[str],
                 condition: Column, limit: int) -> DataFrame:
    """Compare a bucket that bits cannot split further, block against block.

    Every pair of blocks is its own join key of at most about 2 * limit rows, so
    the comparisons spread over tasks; only true pairs leave the join.
    """
    blocks = F.ceil(F.col("size") / limit).cast("int")
    placed = rows.join(sizes, keys).withColumn("_blocks", blocks).withColumn(
        "_block", F.pmod(F.xxhash64("phash"), F.col("_blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = placed.withColumn("_other", every)
    right = placed.withColumn("_other", every)
    joined = left.alias("a").join(
        right.alias("b"),
        [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        + [F.col("a._block") == F.col("b._other"), F.col("a._other") == F.col("b._block"),
           condition],
    )
    return joined.select(
        F.col("a.gallery").alias("gallery"),
        F.col("a.phash").alias("u"), F.col("b.phash").alias("v"),
    )


def _sure_edges(hashes: DataFrame, threshold: int) -> DataFrame:
    """Edges that one pass finds: same window of bits, or close to the hub."""
    if threshold == 0:
        return hashes.select(
            "gallery", F.col("phash").alias("u"), F.col("phash").alias("v")
        ).limit(0)
    return _window_edges(hashes, threshold).unionByName(
        _hub_edges(hashes, threshold)
    ).distinct()


def _split(rows: DataFrame, level: int, parts: int) -> DataFrame:
    """Each row once per band: its bucket is the path of bands and their bits."""
    children = F.array(*[
        F.array(*[F.lit(_signed(mask)) for mask in group])
        for group in _split_masks(level, parts)
    ])
    return rows.select(
        "gallery", "phash", F.col("path").alias("up"),
        F.posexplode(F.get(children, F.col("path"))).alias("band", "mask"),
    ).select(
        "gallery", "phash", (F.col("up") * parts + F.col("band")).alias("path"),
        F.col("phash").bitwiseAND(F.col("mask")).alias("bits"),
    )


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with the root of their component under the edges found so far."""
    roots = component_roots(edges, "gallery").withColumnRenamed("node", "phash")
    return rows.join(roots, ["gallery", "phash"], "left").withColumn(
        "root", F.coalesce("root", "phash")
    )


def _open_buckets(rooted: DataFrame) -> DataFrame:
    """Sizes of the buckets whose members are not all connected yet."""
    return rooted.groupBy(*_BUCKET).agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")
    ).filter(F.col("low") != F.col("high")).select(*_BUCKET, "size")


def _split_edges(hashes: DataFrame, threshold: int, limit: int) -> DataFrame:
    """Edges of galleries that are too large for one bucket.

    Only pairs of different components are compared, so a dense cluster that
    earlier edges connect drops out instead of being compared pair by pair.
    """
    parts = threshold + 1
    deepest = 1
    while parts ** (deepest + 1) <= MOST_MASKS and deepest < 3:
        deepest += 1
    unlinked = _close(threshold) & (F.col("a.root") != F.col("b.root"))
    edges = cut(_sure_edges(hashes, threshold))
    rows = hashes.select("gallery", "phash", F.lit(0).alias("path"))
    for level in range(1, deepest + 1):
        rows = _split(rows, level, parts)
        rooted = cut(_rooted(rows, edges))
        sizes = cut(_open_buckets(rooted))
        small = sizes.filter(F.col("size") <= limit).drop("size")
        large = sizes.filter(F.col("size") > limit).drop("size")
        checked = rooted.join(broadcast_if_small(small), _BUCKET, "left_semi")
        edges = cut(edges.unionByName(_edges_inside(checked, _BUCKET, unlinked)).distinct())
        if is_empty(large):
            return edges
        rows = rooted.join(broadcast_if_small(large), _BUCKET, "left_semi").drop("root")
    rooted = cut(_rooted(rows, edges))
    last = _block_edges(rooted, _open_buckets(rooted), _BUCKET, unlinked, limit)
    return edges.unionByName(last).distinct()


def near_edges(hashes: DataFrame, threshold: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """Edges (gallery, u, v) whose components are the near-duplicate clusters.

    For a gallery of up to `limit` distinct hashes these are all close pairs; for
    a larger one enough of them to connect every close pair, and at least one for
    every hash that has a close neighbour.
    """
    sizes = hashes.groupBy("gallery").count().filter(F.col("count") > limit)
    large = cut(sizes.select("gallery"))
    if is_empty(large):
        return _edges_inside(hashes, ["gallery"], _close(threshold))
    large = broadcast_if_small(large)
    small_part = hashes.join(large, "gallery", "left_anti")
    large_part = cut(hashes.join(large, "gallery", "left_semi"))
    return _edges_inside(small_part, ["gallery"], _close(threshold)).unionByName(
        _split_edges(large_part, threshold, limit)
    )


def near_copies(members: DataFrame, threshold: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """Distinct hashes with their copies and whether another photo is close."""
    hashes = cut(distinct_hashes(members))
    edges = near_edges(hashes, threshold, limit)
    touched = edges.select("gallery", F.explode(F.array("u", "v")).alias("phash")).distinct()
    return (
        hashes.join(touched.withColumn("linked", F.lit(True)), ["gallery", "phash"], "left")
        .select("gallery", "phash", "copies",
                (F.col("linked").isNotNull() | (F.col("copies") > 1)).alias("has_near_copy"))
    )


def duplicate_groups(members: DataFrame, threshold: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """(gallery, duplicate_groups): clusters with more than one photo."""
    hashes = cut(distinct_hashes(members))
    roots = component_roots(near_edges(hashes, threshold, limit), "gallery")
    linked = roots.groupBy("gallery").agg(F.countDistinct("root").alias("groups"))
    alone = (
        hashes.filter(F.col("copies") > 1)
        .join(roots.withColumnRenamed("node", "phash"), ["gallery", "phash"], "left_anti")
        .groupBy("gallery").agg(F.count(F.lit(1)).alias("groups"))
    )
    return linked.unionByName(alone).groupBy("gallery").agg(
        F.sum("groups").alias("duplicate_groups")
    )
