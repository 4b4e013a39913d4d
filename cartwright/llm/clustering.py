"""Lloyd's clustering in whole numbers, with Ptolemaic bounds that spare distance computations.

For pivots p and s, a vector q and a centroid c, Ptolemy's inequality gives

    d(q, c) >= |d(q, p) d(c, s) - d(q, s) d(c, p)| / d(p, s).

The pivots are fixed, so a vector's distances to them are computed once and kept beside it; only the
centroids' are new in each round. Bounds are rounded down; what they can't rule out is computed exactly.
A round is one pass over the vectors, which returns sums for each task; the driver holds the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.common import stored

DIMENSIONS = 64
SCALE = 1024
#: Components from here on are too large for 64-bit squared distances.
LIMIT = 1 << 27
#: More than the relative rounding errors of a bound, of a distance and of a square together.
SLACK = 1e-12


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch["embedding"]
        rows = pc.indices_nonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), DIMENSIONS), False))
        values = pc.fill_null(vectors.take(rows).flatten().cast(pa.float64()), np.nan)
        found = np.floor(SCALE * values.to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS))
        fits = (np.abs(found) < LIMIT).all(axis=1)  # false for NaN
        rows = rows.take(pa.array(np.flatnonzero(fits)))
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"].take(rows), pa.array([v.tobytes() for v in found[fits].astype("<i4")], pa.binary())],
            names=["vec_id", "v"],
        )


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the floor of 1024 times each component as little-endian 32-bit integers.

    Vectors of another length, or with null, NaN or infinite components, are left out, as are those with
    a component of 2**17 or more, whose squared distances 64 bits can't hold.
    """
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return ids.mapInArrow(_quantised, "vec_id long, v binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, DIMENSIONS).astype(np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def _between(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances, correctly rounded roots of exact squares."""
    squares = np.empty((len(rows), len(points)))
    for number, point in enumerate(points):
        squares[:, number] = _squared(rows, point[None])
    return np.sqrt(squares)


class Pivots:
    """Fixed pivots, and the pairs of them that bound distances: neighbours in a ring that are apart."""

    def __init__(self, points: np.ndarray):
        self.points = points
        apart = _between(points, points)
        ring = {tuple(sorted((i, (i + 1) % len(points)))) for i in range(len(points))}
        self.pairs = [(p, s, apart[p, s]) for p, s in sorted(ring) if apart[p, s] > 0]

    def bounds(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, rounded down, from distances to the pivots."""
        best = np.zeros((len(rows), len(centroids)))
        for p, s, apart in self.pairs:
            one, two = rows[:, p, None] * centroids[None, :, s], rows[:, s, None] * centroids[None, :, p]
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / apart, out=best)
        return best * best * (1 - SLACK)


def nearest(
    vectors: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller one of a tie), squared distance, distances computed."""
    bounds = pivots.bounds(cached, _between(centroids, pivots.points))
    label = bounds.argmin(axis=1)
    distance = _squared(vectors, centroids[label])
    first, computed = label.copy(), len(vectors)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero((bounds[:, number] <= distance) & (first != number))
        apart = _squared(vectors[rows], centroid[None])
        computed += len(rows)
        closer = (apart < distance[rows]) | ((apart == distance[rows]) & (number < label[rows]))
        label[rows[closer]], distance[rows[closer]] = number, apart[closer]
    return label, distance, computed


def _with_pivot_distances(pivots: Pivots):
    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _between(_matrix(batch["v"]), pivots.points) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([row.tobytes() for row in apart], pa.binary())], names=["vec_id", "v", "apart"]
            )

    return cache


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, pivots: Pivots):
    vectors = _matrix(batch["v"])
    cached = np.frombuffer(b"".join(batch["apart"].to_pylist()), np.float64).reshape(len(vectors), -1)
    return vectors, *nearest(vectors, cached, centroids, pivots)


def _sums(centroids: np.ndarray, pivots: Pivots):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in filter(len, batches):
            vectors, label, _, _ = _assigned(batch, centroids, pivots)
            for number in np.unique(label):
                own = vectors[label == number]
                total[number] += own.sum(axis=0)
                count[number] += len(own)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    return sums


def _assignments(centroids: np.ndarray, pivots: Pivots):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            _, label, distance, _ = _assigned(batch, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return assign


def _moved(kept: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Every centroid's mean, rounded down; sums are decimals, which don't overflow."""
    tasks = kept.mapInArrow(_sums(centroids, pivots), "cluster int, n long, total array<long>")
    means = (
        tasks.select("cluster", "n", F.posexplode("total").alias("at", "part"))
        .groupBy("cluster", "at")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    new = centroids.copy()
    for row in means:
        new[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return new


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """One row per kept vector (``quantised``): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id`` (nothing behind the colon
    for a null one), equal ones by their components; with fewer vectors there are fewer centroids. These
    first centroids are the pivots throughout. Each round moves every centroid that has vectors to their
    mean, rounded down; rounds after which nothing has moved are not repeated. Rows with one vec_id are
    vectors of their own, other columns play no part, and an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    raw = stored(quantised(vectors), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = raw.orderBy(name, "v").limit(k).collect()
    points = np.array([np.frombuffer(r["v"], "<i4") for r in start], np.int64).reshape(-1, DIMENSIONS)
    pivots = Pivots(points)
    kept = stored(raw.mapInArrow(_with_pivot_distances(pivots), "vec_id long, v binary, apart binary"), "vectors-pivots")
    centroids = points
    for _ in range(rounds):
        moved = _moved(kept, centroids, pivots)
        if (moved == centroids).all():
            break
        centroids = moved
    labels = stored(kept.mapInArrow(_assignments(centroids, pivots), "vec_id long, cluster int, distance long"), "clusters")
    sums = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = {r["cluster"]: int(r["total"]) for r in sums}
    rows = [
        (number, inertia[number], sum(inertia.values()), sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for number, c in enumerate(centroids) if number in inertia
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
