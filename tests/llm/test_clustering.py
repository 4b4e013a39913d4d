"""Clusters against plain integer Lloyd rounds, and the bounds that spare distances."""

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from cartwright.llm import clustering

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, rounds):
    kept = []
    for vec_id, x in rows:
        if x is None or len(x) != 64 or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((vec_id, [math.floor(1024 * float(np.float32(v))) for v in x]))
    name = lambda r: sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    raw = lambda v: np.array(v, "<i4").tobytes()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r), raw(r[1])))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def labels():
        return [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = labels()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = labels()
    total = Counter()
    for d, n in found:
        total[n] += d
    return Counter(
        (i, n, d, total[n], total.total(), sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
        for (i, _), (d, n) in zip(kept, found, strict=True)
    )


def vectors(rng, n, spread=0.3):
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_equals_plain_rounds(spark, rounds):
    rows = vectors(random.Random(rounds), 200)
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(3, rows[9][1]), (3, rows[8][1])]
    found = clustering.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=rounds).collect()
    assert Counter(map(tuple, found)) == plain(rows, 8, rounds)


def test_odd_vectors(spark):
    rng = random.Random(2)
    rows = vectors(rng, 12)
    good = rows[0][1]
    rows += [(50, None), (51, []), (52, good[:63]), (53, [*good, 0.0]), (54, [None, *good[1:]]), (55, [math.nan, *good[1:]]),
             (56, [math.inf, *good[1:]]), (None, good), (None, good), (57, [0.0] * 64), (58, [-1e5] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS v", "'own' AS apart", "'own' AS cluster", "1 AS distance")
    assert Counter(map(tuple, clustering.clusters(df).collect())) == plain(rows, 8, 10)
    assert clustering.clusters(df.filter("false")).collect() == []
    few = [(1, good), (2, good), (3, rows[1][1])]
    assert Counter(map(tuple, clustering.clusters(spark.createDataFrame(few, SCHEMA)).collect())) == plain(few, 8, 10)
    assert clustering.clusters(spark.createDataFrame([(60, [2.0**20] * 64)], SCHEMA)).collect() == []


def test_ties_go_to_the_smaller_number():
    points = np.zeros((3, 64), np.int64)
    points[1, 0], points[2, 0] = 2, 2
    pivots = clustering.Pivots(points)
    rows = np.zeros((2, 64), np.int64)
    rows[0, 0], rows[1, 0] = 1, 5
    label, distance, _ = clustering.nearest(rows, clustering._between(rows, points), points, pivots)
    assert label.tolist() == [0, 1] and distance.tolist() == [1, 9]


@pytest.mark.parametrize("size", [3, 1000, clustering.LIMIT - 1])
def test_bounds_hold_and_spare_work(size):
    rng = np.random.default_rng(size)
    middles = rng.integers(-size, size + 1, (8, 64))
    rows = np.clip(middles[rng.integers(0, 8, 2000)] + rng.integers(-size // 10 - 1, size // 10 + 2, (2000, 64)), -size, size)
    pivots = clustering.Pivots(rows[:8])
    cached = clustering._between(rows, pivots.points)
    bounds = pivots.bounds(cached, clustering._between(middles, pivots.points))
    exact = np.stack([clustering._squared(rows, m[None]) for m in middles], axis=1)
    assert (bounds <= exact).all()
    label, distance, computed = clustering.nearest(rows, cached, middles, pivots)
    assert (label == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert size < 1000 or computed < 0.8 * exact.size
