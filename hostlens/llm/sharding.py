"""Minimax contiguous partition of ordered atomic groups into shards."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.session import cut

SALTS = 1024  # parts in which the rows of one group are counted and numbered
BUCKETS = 65536  # ranges of the group order whose sums one window adds up
FIRST_BINS, BINS = 16384, 512  # sums that reach the driver in the first and in later passes


class _Sums:
    """Bounds for "the largest group end up to x", from binned group ends.

    Each bin is (smallest end, largest end) of ends that are no more than that known.
    """

    def __init__(self, bins: list[tuple[int, int]]) -> None:
        self.bins = sorted(bins)
        self.low = [b[0] for b in self.bins]

    def reach(self, x: int) -> tuple[int, int]:
        k = bisect.bisect_right(self.low, x) - 1
        if k < 0:
            return 0, 0
        low, high = self.bins[k]
        return (high, high) if x >= high else (low, min(x, high - 1))


def _walk(sums: _Sums, capacity: int, shards: int, total: int) -> list[tuple[int, int]]:
    """Greedy filling: bounds for the end of each shard."""
    ends, low, high = [], 0, 0
    for _ in range(shards):
        low = max(low, sums.reach(min(total, low + capacity))[0])
        high = max(high, sums.reach(min(total, high + capacity))[1])
        ends.append((low, high))
    return ends


def minimax_cuts(groups: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest feasible capacity and the group ends where greedy cuts.

    `groups` has `end_bytes`, the running sum of the ordered sizes. The capacity is found by
    binary search; greedy filling checks each. Both run on binned running sums, at most a
    few thousand numbers on the driver, which bound each shard's end from both sides. Where
    the bounds leave a capacity open, the next pass has finer bins around the ends that
    matter, until every bin that decides holds one end.
    """
    if not total:
        return 0, [0] * shards
    lower = max(largest, -(-total // shards)) - 1  # not feasible, or one less than the bound
    upper = -(-total // shards) + largest  # feasible
    windows, bins_each, finer = [(0, total)], FIRST_BINS, BINS
    while True:
        sums = _Sums(_binned(groups, windows, bins_each, total))

        def search(side: int, low: int, high: int) -> tuple[int, int]:
            while high - low > 1:
                middle = (low + high) // 2
                if _walk(sums, middle, shards, total)[-1][side] < total:
                    low = middle
                else:
                    high = middle
            return low, high

        # the largest capacity that surely fails, the smallest that surely holds
        lower, _ = search(1, lower, upper)
        _, upper = search(0, lower, upper)
        ends = _walk(sums, upper, shards, total)
        if upper - lower == 1 and all(a == b for a, b in ends):
            return upper, [a for a, _ in ends]
        first = _walk(sums, lower, shards, total)
        starts = [0, *(low for low, _ in first[:-1])]
        stops = [0, *(high for _, high in ends[:-1])]
        windows = [(min(total, a + lower), min(total, b + upper))
                   for a, b in zip(starts, stops, strict=True)]
        # each pass looks closer, whether or not the last one settled anything
        bins_each, finer = finer, 2 * finer


def _binned(groups: DataFrame, windows: list[tuple[int, int]], bins_each: int,
            total: int) -> list[tuple[int, int]]:
    """(smallest, largest) end of each bin: fine bins inside the windows, one for each gap."""
    merged: list[list[int]] = []
    for start, stop in sorted(windows):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
            merged[-1][2] += bins_each
        else:
            merged.append([start, stop, bins_each])
    parts, at = [], 0  # (start, width of its bins); a part reaches to the next one's start
    for start, stop, bins in merged:
        if start > at:
            parts.append((at, max(1, start - at)))
        parts.append((start, max(1, -(-(stop - start) // bins))))
        at = stop
    if at < total:
        parts.append((at, total - at))
    end, part = F.col("end_bytes"), F.lit(0)
    for start, _ in parts[1:]:
        part = part + (end > F.lit(start).cast("bigint")).cast("int")
    starts, widths = (F.array(*[F.lit(p[k]).cast("bigint") for p in parts]) for k in (0, 1))
    rows = (
        groups.select("end_bytes", part.alias("part"))
        .withColumn("bin", F.floor((end - starts[F.col("part")] - 1) / widths[F.col("part")]))
        .groupBy("part", "bin").agg(F.min(end).alias("low"), F.max(end).alias("high"))
        .collect())
    return [(r["low"], r["high"]) for r in rows]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; equal texts share a shard.

    Groups are ordered by the SHA-256 of their text, so the order is random but fixed. A
    group above an even share of the rest takes a shard alone (at most shards - 1 such
    groups, found as the largest ones); the rest is cut into the other shards at the
    smallest feasible capacity. Slots number the rows of a shard from 0 in group order.

    Size: UTF-8 bytes plus 8. Null texts are in one group with empty ones. Null or repeated
    ids are rows like others. An empty table gives an empty result. No window spans a
    group: rows of a group are counted and numbered in SALTS parts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    atoms = cut(rows.groupBy("group", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-atoms")
    sizes = atoms.groupBy("group").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    bucket = F.conv(F.hex(F.substring("group", 1, 2)), 16, 10).cast("int")
    sizes = cut(sizes.withColumn("bucket", bucket), "shard-groups")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    giants, left = [], shards
    for row in sizes.orderBy(F.desc("bytes"), "group").select("group", "bytes").limit(shards).collect():
        if left > 1 and row["bytes"] * left > total:
            giants.append(bytes(row["group"]))
            total, left = total - row["bytes"], left - 1
        else:
            break
    alone = F.col("group").isin(giants) if giants else F.lit(False)
    small = sizes.filter(~alone)
    largest = small.agg(F.max("bytes")).first()[0] or 0
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r")).select(
        "bucket", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("r").over(ahead), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("bucket").orderBy("group").rowsBetween(
        Window.unboundedPreceding, 0)
    ordered = cut(small.join(starts, "bucket").select(
        "group", (F.col("b0") + F.sum("bytes").over(inside)).alias("end_bytes"),
        (F.col("r0") + F.sum("n").over(inside) - F.col("n")).alias("start_row")), "shard-order")
    _, cuts = minimax_cuts(ordered, left, total, largest)
    shard = F.lit(0)
    for at in cuts[:-1]:
        shard = shard + (F.col("end_bytes") > F.lit(at).cast("bigint")).cast("int")
    placed = ordered.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("start_row").alias("first_row"))
    placed = placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "group", "shard", (F.col("start_row") - F.col("first_row")).alias("slot0"))
    for k, giant in enumerate(giants):
        placed = placed.unionByName(sizes.filter(F.col("group") == F.lit(giant)).select(
            "group", F.lit(left + k).alias("shard"), F.lit(0).cast("bigint").alias("slot0")))
    # at most SALTS rows in a window
    earlier = Window.partitionBy("group").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1)
    atoms = atoms.select("group", "salt", F.coalesce(
        F.sum("n").over(earlier), F.lit(0)).alias("slot1")).join(placed, "group")
    turn = F.row_number().over(Window.partitionBy("group", "salt").orderBy("doc_id"))
    return rows.join(atoms, ["group", "salt"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("slot0") + F.col("slot1") + turn - 1).cast("bigint").alias("slot"))
