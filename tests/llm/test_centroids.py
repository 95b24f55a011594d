import hashlib
import math
import random

import numpy as np
import pytest

from palisade.llm import centroids
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, count=16, rounds=3):
    """Contract by full search over Python integers."""
    kept = [(i, [max(-2 ** 27, min(2 ** 27, math.floor(64 * float(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    found = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:count]]
    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(found))
    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        moved = list(found)
        for k in range(len(found)):
            own = [x for (_, x), a in zip(kept, at) if a == k]
            if own:
                moved[k] = [sum(c) // len(own) for c in zip(*own)]
        found = moved
    last = [nearest(x) for _, x in kept]
    inertia = {k: sum(d for d, c in last if c == k) for k in range(len(found))}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return [(i, k, d, inertia[k], sum(inertia.values()), told[k]) for (i, _), (d, k) in zip(kept, last)]


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(count, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (5, 64))
    return [(int(k), (middles[k % 5] + rng.normal(0, 0.3, 64)).astype("f4").tolist()) for k in range(count)]


def test_search_equals_full_search():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 50, 10 ** 6, centroids.LARGEST):
        own = rng.integers(-spread, spread + 1, (16, 64))
        own[5] = own[2]  # the smaller number wins
        x = np.concatenate([rng.integers(-spread, spread + 1, (500, 64)), own, (own[:8] + own[8:]) // 2])
        every = ((x[:, None, :] - own[None]) ** 2).sum(axis=2)
        number, distance = centroids.Search(own).nearest(x)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_ties_on_a_line():
    own = np.array([[4] * 64, [0] * 64, [-4] * 64, [0] * 64])
    number, distance = centroids.Search(own).nearest(np.array([[2] * 64, [-2] * 64, [0] * 64, [9] * 64]))
    assert number.tolist() == [0, 1, 1, 0] and distance.tolist() == [256, 256, 0, 1600]


def test_most_centroids_are_rejected_unmeasured(monkeypatch):
    rng = np.random.default_rng(3)
    own = rng.integers(-9, 9, (64, 64)) + np.arange(-320, 320, 10)[:, None]
    measured = []
    einsum = np.einsum
    monkeypatch.setattr(centroids.np, "einsum", lambda s, a, b: measured.append(len(a)) or einsum(s, a, b))
    search = centroids.Search(own)
    measured.clear()
    search.nearest(own[rng.integers(0, 64, 1000)] + rng.integers(-2, 3, (1000, 64)))
    assert sum(measured) - 1000 < 3 * 1000  # of 64 each; the first call measures the spreads


ODD = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 63), (5, [1.0] * 65), (6, [float("nan")] + [1.0] * 63),
       (7, [float("inf")] + [1.0] * 63), (8, [None] + [1.0] * 63), (None, [0.5] * 64), (9, [3e38] * 64), (9, [-3e38] * 64),
       (10, [-0.01] * 64), (10, [-0.01] * 64)]


@pytest.mark.parametrize("rows", [ODD, ODD[2:3], ODD[:2], vectors(300) + ODD, [(k, [0.25] * 64) for k in range(40)]])
def test_whole_operator(spark, rows):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "'x' AS cluster", "1 AS distance", "2 AS inertia")
    limit = 2 ** 63 - 1
    want = [(i, k, d, min(c, limit), min(s, limit), h) for i, k, d, c, s, h in plain(rows)]
    assert rows_of(centroids.cluster(frame), *COLUMNS) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_other_sizes(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(k % 3, 0.1) for _ in range(64)]) for k in range(90)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = plain([(i, np.array(v, "f4").tolist()) for i, v in rows], 4, 5)
    assert rows_of(centroids.cluster(frame, count=4, rounds=5), *COLUMNS) == sorted(want)
