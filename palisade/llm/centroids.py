"""Centroid clustering of integer vectors by equal-average equal-variance search.

For a vector x of d integers let S(x) be the sum of its components and V(x) the length of what
remains when each component is set off by their mean. Then
|x - c|^2 >= (S(x) - S(c))^2 / d + (V(x) - V(c))^2. Centroids are sorted by their mean. A vector's search starts
at its own mean and goes outward; when the first term alone is above the best distance so
far, all centroids further out are as well, and the search ends. A centroid is passed over
when both terms together are above it. The others are measured with integers, so distances
and ties (which go to the smaller number) are exact.

Vectors of a batch go through these steps side by side. A round reads all vectors and sends
one row of sums per task, centroid and component; nothing else is shuffled, and what the
driver sees is one row per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches
from palisade.session import settle

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
SEED = 1
# Components beyond this count as this: the square of any distance then fits 64 bits.
LARGEST = 1 << 27
ROWS = 4096  # searched side by side


def integers(embeddings: pa.Array, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column are usable, and their integer vectors."""
    sizes = embeddings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = sizes == dimensions
    values = embeddings.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = values.reshape(-1, dimensions)
    good = np.isfinite(values).all(axis=1)  # a null component has become NaN
    usable = fits.copy()
    usable[fits] = good
    with np.errstate(over="ignore"):
        made = np.clip(np.floor(values[good] * scale), -LARGEST, LARGEST)
    return usable, made.astype(np.int64)


class Search:
    """Nearest centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        """``centroids``: integers, one row per centroid in the order of their numbers."""
        sums = centroids.sum(axis=1)
        # Equal means stay in the order of their numbers.
        self.numbers = np.argsort(sums, kind="stable")
        self.centroids, self.sums = centroids[self.numbers], sums[self.numbers]
        self.spreads = self._spread(self.centroids, self.sums)

    @staticmethod
    def _spread(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
        centred = vectors - (sums / vectors.shape[1])[:, None]
        return np.sqrt(np.einsum("nd,nd->n", centred, centred))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and its squared distance."""
        count, dimensions = vectors.shape
        number, best = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
        sums = vectors.sum(axis=1)
        spreads = self._spread(vectors, sums)
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        active = np.arange(count)
        while len(active):
            # The nearer of the next centroid upward and the next one downward, by mean.
            up, down = above[active], below[active]
            gap_up = np.where(up < len(self.sums), self.sums[np.minimum(up, len(self.sums) - 1)] - sums[active], np.iinfo(np.int64).max)
            gap_down = np.where(down >= 0, sums[active] - self.sums[np.maximum(down, 0)], np.iinfo(np.int64).max)
            upward = gap_up <= gap_down
            at, gap = np.where(upward, up, down), np.minimum(gap_up, gap_down)
            # The bounds are lowered by far more than the rounding of doubles, so a rejection is certain.
            mean_term = gap.astype(np.float64) ** 2 / dimensions
            going = (gap < np.iinfo(np.int64).max) & (mean_term * (1 - 1e-9) <= best[active])
            active, at, upward, mean_term = active[going], at[going], upward[going], mean_term[going]
            above[active[upward]] += 1
            below[active[~upward]] -= 1
            spread = np.abs(spreads[active] - self.spreads[at])
            slack = 1e-9 * (spreads[active] + self.spreads[at] + 1)
            near = mean_term * (1 - 1e-9) + np.maximum(spread - slack, 0) ** 2 * (1 - 1e-9) <= best[active]
            rows, at = active[near], at[near]
            off = vectors[rows] - self.centroids[at]
            distance = np.einsum("nd,nd->n", off, off)
            found = self.numbers[at]
            better = (distance < best[rows]) | (distance == best[rows]) & (found < number[rows])
            rows = rows[better]
            best[rows], number[rows] = distance[better], found[better]
        return number, best


def _searched(vectors: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    made = [search.nearest(vectors[k:k + ROWS]) for k in range(0, len(vectors), ROWS)]
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([n for n, _ in made]), np.concatenate([d for _, d in made])


def starts(rows: DataFrame, count: int = CENTROIDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> np.ndarray:
    """The first centroids: the vectors with the smallest digests of seed and id.

    Ids are digested once per vector; equal digests, of one id, are taken in the order of
    their components, and rows without an id come last.
    """
    def task(batch: pa.RecordBatch) -> dict:
        usable, made = integers(batch.column(1), dimensions, scale)
        return {"vec_id": batch.column(0).filter(pa.array(usable)), "x": list(made)}

    kept = over_batches(rows, "vec_id long, x array<long>", task)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(digest.asc_nulls_last(), "x").limit(count).select("x").collect()
    return np.array([r["x"] for r in chosen], np.int64).reshape(-1, dimensions)


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of the vectors of every centroid that has any."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        totals, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            _, vectors = integers(batch.column(1), dimensions, scale)
            numbers, _ = _searched(vectors, search)
            for c in np.unique(numbers):
                own = vectors[numbers == c]
                totals[c] += own.sum(axis=0)
                counts[c] += len(own)
        kept = [c for c in range(len(counts)) if counts[c]]
        if kept:
            yield pa.RecordBatch.from_arrays([
                pa.array([c for c in kept for _ in range(dimensions)], pa.int32()),
                pa.array(list(range(dimensions)) * len(kept), pa.int32()),
                pa.array([int(counts[c]) for c in kept for _ in range(dimensions)], pa.int64()),
                pa.array([int(totals[c][d]) for c in kept for d in range(dimensions)], pa.decimal128(38, 0)),
            ], names=["cluster", "component", "n", "total"])

    made = rows.mapInArrow(run, "cluster int, component int, n long, total decimal(38,0)")
    # One row per centroid and component.
    found: dict[int, tuple[int, list[int]]] = {}
    for r in made.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        found.setdefault(r["cluster"], (r["n"], [0] * dimensions))[1][r["component"]] = int(r["total"])
    return found


def fit(rows: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
        dimensions: int = DIMENSIONS, scale: int = SCALE) -> np.ndarray:
    """The centroids after so many rounds of assigning and averaging; an empty one stays where it is."""
    centroids = starts(rows, count, seed, dimensions, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, total) in _sums(rows, centroids, scale).items():
            centroids[c] = [t // n for t in total]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance`` of the usable vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            usable, vectors = integers(batch.column(1), centroids.shape[1], scale)
            numbers, distances = _searched(vectors, search)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(usable)), pa.array(numbers.astype(np.int32)), pa.array(distances)],
                names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
            dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per usable vector.

    Vectors that are null, have another length, or have null or non-finite components are
    left out; components beyond ``LARGEST`` after scaling count as that. With fewer usable
    vectors than centroids each vector starts one. Repeated rows are vectors of their own; a
    null id stays null. Inertias beyond 64 bits show the largest long. An empty table gives no rows; other
    columns are ignored. There are no texts.
    """
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = fit(plain, count, rounds, seed, dimensions, scale)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], names)
    assigned = settle(assign(plain, centroids, scale), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One row per centroid.
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(exact.alias("s")).collect()}
    fits = lambda x: min(x, 2 ** 63 - 1)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    told = rows.sparkSession.createDataFrame(
        [(c, fits(s), fits(sum(sums.values())), digest(c)) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(*[n.split()[0] for n in names.split(", ")])
