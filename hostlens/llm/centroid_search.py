"""Exact integer k-means whose nearest-centroid search is pruned by component mean and deviation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.session import cut

SCALE = 64
# components beyond this are set to it, so that 64-bit distances of up to 64 components are exact
LIMIT = 1 << 27
MOST_COMPONENTS = 64
ROWS = 4096  # vectors that are searched together


def _codes(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double, within LIMIT."""
    bound = F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.greatest(F.least(
        F.floor(x.cast("double") * float(scale)).cast("double"), bound), -bound).cast("int"))


def integer_vectors(vectors: DataFrame, size: int, id_col: str = "vec_id",
                    vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, codes) of the vectors with exactly `size` components, none null or not finite.

    Components beyond LIMIT in the integer scale are set to LIMIT.
    """
    if not 0 < size <= MOST_COMPONENTS:
        raise ValueError(f"vectors need 1 to {MOST_COMPONENTS} components")
    vector = F.col(vector_col)
    good = F.size(vector) == size
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(vector.isNotNull() & good & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), _codes(vector, scale).alias("codes"))


class CentroidSearch:
    """Nearest of k integer centroids by squared distance; of equal ones the smaller number.

    Centroids are sorted by the sum of their components (their mean times the size). For a
    vector x and a centroid c of n components, with sums s and deviations v (the length of
    what is left when the mean is taken off):

        n * d2 >= (s_x - s_c) ** 2                     (equal average)
        d2 >= (s_x - s_c) ** 2 / n + (v_x - v_c) ** 2  (equal variance)

    The scan goes outward from the place of the vector's own sum. A side ends with the first
    centroid that the first inequality rejects, since sums only get further away there;
    single centroids are rejected by the second. What is left is compared in integers. The
    deviations are floats, so that bound is lowered by more than its error; the first one is
    exact.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        sums = centroids.sum(axis=1)
        self.order = np.lexsort((np.arange(len(centroids)), sums))
        self.centroids = centroids[self.order]
        self.sums = sums[self.order]
        self.size = centroids.shape[1]
        self.deviations = self._deviations(self.centroids, self.sums)
        self.compared = 0  # exact distances so far

    def _deviations(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        centred = rows - (sums / self.size)[:, None]
        return np.sqrt(np.einsum("ij,ij->i", centred, centred))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the centroid, squared distance) of each row."""
        n, k = len(rows), len(self.centroids)
        sums = rows.sum(axis=1)
        deviations = self._deviations(rows, sums)
        best = np.full(n, np.iinfo(np.int64).max)
        found = np.full(n, k, dtype=np.int64)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        live = np.arange(n)
        while len(live):
            lo, hi = left[live], right[live]
            below = np.where(lo >= 0, sums[live] - self.sums[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[live],
                             np.iinfo(np.int64).max)
            down = below <= above
            gap = np.where(down, below, above)
            # the nearer side decides: if it is rejected, so is all that is left on both
            some = gap < np.iinfo(np.int64).max
            some[some] = ~self._mean_rejects(gap[some], best[live[some]])
            live, at, gap, down = live[some], np.where(down, lo, hi)[some], gap[some], down[some]
            left[live[down]] -= 1
            right[live[~down]] += 1
            apart = deviations[live] - self.deviations[at]
            bound = gap.astype(np.float64) ** 2 / self.size + apart ** 2
            scale = 1.0 + deviations[live] ** 2 + self.deviations[at] ** 2 + bound
            near = bound - 1e-9 * scale <= best[live]
            rows_at, cells = live[near], at[near]
            delta = rows[rows_at] - self.centroids[cells]
            distance = np.einsum("ij,ij->i", delta, delta)
            self.compared += len(rows_at)
            number = self.order[cells]
            better = (distance < best[rows_at]) | (
                (distance == best[rows_at]) & (number < found[rows_at]))
            best[rows_at[better]] = distance[better]
            found[rows_at[better]] = number[better]
        return found, best

    def _mean_rejects(self, gap: np.ndarray, best: np.ndarray) -> np.ndarray:
        """gap ** 2 > size * best, in integers: the quotient keeps it within 64 bits."""
        most = np.iinfo(np.int64).max
        small = gap < (1 << 31)
        square = np.where(small, np.where(small, gap, 0) ** 2, 0)
        # beyond 31 bits: gap ** 2 // size by parts, exact for sizes up to 64
        whole, rest = gap // self.size, gap % self.size
        wide = (whole.astype(np.float64) * gap + whole * rest) * (1 - 1e-12) > best
        exact = square > np.where(best > most // self.size, most, best * self.size)
        return np.where(small, exact, wide)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order.

    Rows of equal id follow their codes. Rows without an id start no centroid.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = rows.filter("vec_id is not null").select(key.alias("key"), "codes").orderBy(
        "key", "codes").limit(k).collect()
    return np.array([r["codes"] for r in drawn], dtype=np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty centroid replaced by the floor of its vectors' mean, exactly.

    A task sums its vectors by centroid before anything is shuffled: k rows leave it.
    """
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centroids)
        total = np.zeros(centroids.shape, dtype=np.int64)
        count = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            whole = _matrix(batch.column(0), size)
            for at in range(0, len(whole), ROWS):
                part = whole[at: at + ROWS]
                found, _ = search.nearest(part)
                count += np.bincount(found, minlength=len(count))
                np.add.at(total, found, part)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]),
             pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("codes").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    wide = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy(
        "cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
                            F.sum("n").alias("n"))
    moved = centroids.copy()
    for r in wide.collect():  # k rows of `size` numbers
        moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return moved


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64,
                    seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept vectors.

    k-means over `integer_vectors`: `rounds` times each vector goes to its nearest centroid
    and each centroid with vectors moves to the floor of their mean; then vectors are
    assigned once more. Only k centroids and their sums (k times `size` numbers) reach the
    driver and the tasks.

    Null, short, long and non-finite vectors have no row. Repeated rows count each. A null id
    stays in the result but starts no centroid. With fewer vectors than k there are fewer
    centroids, and without any (or none with an id) no rows. inertia is null beyond 64 bits.
    Other columns, whatever their names, are not read.
    """
    rows = cut(integer_vectors(vectors, size, id_col, vector_col, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    spark = rows.sparkSession
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame(
            [], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(rows, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CentroidSearch(centroids)
        for batch in batches:
            whole = _matrix(batch.column(1), size)
            parts = [search.nearest(whole[at: at + ROWS]) for at in range(0, len(whole), ROWS)]
            if parts:
                found, distance = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"])

    placed = cut(rows.mapInArrow(run, schema), "assigned")
    # one row for each centroid
    sums = placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    inertia = {r["cluster"]: int(r["own"]) for r in sums.collect()}
    whole = sum(inertia.values())

    def fits(x: int) -> int | None:
        return x if x < 1 << 63 else None

    named = spark.createDataFrame(
        [(c, fits(inertia.get(c, 0)), fits(whole), hashlib.sha256(
            ",".join(map(str, row.tolist())).encode()).hexdigest())
         for c, row in enumerate(centroids)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
