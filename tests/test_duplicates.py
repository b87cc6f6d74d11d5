"""Near-duplicate clusters, ranks and components against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostlens.operators import duplicates, ordering
from hostlens.operators.components import component_roots


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_groups(hashes, threshold):
    parent = list(range(len(hashes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(hashes)):
        for j in range(i):
            if bin(hashes[i] ^ hashes[j]).count("1") <= threshold:
                parent[find(i)] = find(j)
    sizes = Counter(find(i) for i in range(len(hashes)))
    return sum(1 for n in sizes.values() if n > 1)


def brute_near(hashes, threshold):
    return sum(
        any(i != j and bin(a ^ b).count("1") <= threshold for j, b in enumerate(hashes))
        for i, a in enumerate(hashes)
    )


def flip(rng, value, n):
    for bit in rng.sample(range(64), n):
        value ^= 1 << bit
    return value


def gallery(rng, size):
    """Random hashes, copies, near copies and chains."""
    rows = [rng.getrandbits(64) for _ in range(size // 2 + 1)]
    while len(rows) < size:
        rows.append(flip(rng, rng.choice(rows), rng.choice([0, 1, 3, 5, 6, 9])))
    return rows


def frame(spark, galleries):
    rows = [(k, signed(h)) for k, hs in galleries.items() for h in hs]
    return spark.createDataFrame(rows, "gallery string, phash bigint")


@pytest.mark.parametrize("limit", [1024, 8])
def test_groups_equal_brute_force(spark, limit):
    rng = random.Random(7)
    galleries = {str(i): gallery(rng, n) for i, n in enumerate([1, 2, 5, 20, 60, 150])}
    members = frame(spark, galleries)
    found = {
        r.gallery: r.duplicate_groups
        for r in duplicates.duplicate_groups(members, 5, limit).collect()
    }
    for key, hashes in galleries.items():
        assert found.get(key, 0) == brute_groups(hashes, 5), key
    near = {
        r.gallery: r.n for r in duplicates.near_copies(members, 5, limit)
        .groupBy("gallery").agg(F.sum(F.when(F.col("has_near_copy"), F.col("copies")).otherwise(0))
                                .alias("n")).collect()
    }
    for key, hashes in galleries.items():
        assert near[key] == brute_near(hashes, 5), key


def test_dense_gallery_reaches_block_comparison(spark):
    # all hashes share most bits, so bit buckets stay full and blocks must decide
    rng = random.Random(3)
    base = rng.getrandbits(64)
    spots = rng.sample(range(64), 26)
    hashes = []
    for _ in range(160):
        value = base
        for bit in rng.sample(spots, 9):
            value ^= 1 << bit
        hashes.append(value)
    found = duplicates.duplicate_groups(frame(spark, {"a": hashes}), 5, 4).collect()
    assert sum(r.duplicate_groups for r in found) == brute_groups(hashes, 5)


def test_copies_collapse(spark):
    members = frame(spark, {"a": [5] * 500 + [1 << 40], "b": [9]})
    [row] = duplicates.duplicate_groups(members, 5).collect()
    assert (row.gallery, row.duplicate_groups) == ("a", 1)
    assert duplicates.distinct_hashes(members).count() == 3


def test_photos_without_hash_take_no_part(spark):
    members = spark.createDataFrame([("a", None), ("a", None)], "gallery string, phash bigint")
    assert duplicates.duplicate_groups(members, 5).count() == 0


def test_split_masks_cover_every_bit():
    for level in (1, 2, 3):
        for group in duplicates._split_masks(level, 6):
            shared = group[0]
            for mask in group[1:]:
                shared &= mask
            free = [mask & ~shared for mask in group]
            assert sum(free) | shared == (1 << 64) - 1
            assert all(a & b == 0 for i, a in enumerate(free) for b in free[:i])


def test_components_of_a_long_chain(spark):
    edges = [("k", i, i + 1) for i in range(200)] + [("k", 500, 501), ("m", 1, 2)]
    random.Random(1).shuffle(edges)
    roots = component_roots(
        spark.createDataFrame(edges, "key string, u bigint, v bigint"), "key"
    ).collect()
    assert {r.root for r in roots if r.key == "k" and r.node <= 200} == {0}
    assert {(r.node, r.root) for r in roots if r.node >= 500} == {(500, 500), (501, 500)}
    assert len(roots) == 201 + 2 + 2


def test_rank_and_position_with_one_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x bigint, id bigint").repartition(6)
    ranked = ordering.rank_all(df, [F.desc("x"), F.asc("id")]).collect()
    expect = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert {r["rank"]: r["id"] for r in ranked} == {i + 1: r[2] for i, r in enumerate(expect)}
    placed = ordering.position_in_group(df, "g", [F.col("x"), F.col("id")]).collect()
    by_group = {}
    for g, x, i in sorted(rows, key=lambda r: (r[1], r[2])):
        by_group.setdefault(g, []).append(i)
    assert {(r.g, r.position): r.id for r in placed} == {
        (g, p + 1): i for g, ids in by_group.items() for p, i in enumerate(ids)
    }
