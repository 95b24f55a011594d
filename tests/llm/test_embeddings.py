import numpy as np
import pytest

from palisade.llm import embeddings
from tests.llm.helpers import groups

SCHEMA = "vec_id long, embedding array<float>, label int, node string, copies int"


def brute(rows, threshold=0.9):
    """n_links and component per row position, in double precision."""
    good = []
    for i, v in rows:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
        good.append(x if i is not None and x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    links = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is not None and y is not None and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    name = groups(links, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[name[k]] = min(x for x in (i, least.get(name[k])) if x is not None) if i is not None or name[k] in least else None
    count = [sum(k in pair for pair in links) for k in range(len(rows))]
    return [(i, count[k], least[name[k]], i is None or i == least[name[k]]) for k, (i, _) in enumerate(rows)]


def run(spark, rows, **options):
    rows32 = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, "x", 1) for i, v in rows]
    got = embeddings.near_duplicates(spark.createDataFrame(rows32, SCHEMA), **options)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str), [(r[0], r[1]) for r in rows32]


def clusters(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 24))
    rows = [(k, rng.normal(size=24).tolist()) for k in range(150)]
    for k, c in enumerate(centres):
        for j in range(25):
            rows.append((200 + 40 * k + j, (c + rng.normal(size=24) * 0.33 * np.linalg.norm(c) / 24 ** 0.5).tolist()))
    return rows


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_against_all_pairs(spark, block_rows):
    got, rows = run(spark, clusters(), block_rows=block_rows)
    assert got == sorted(brute(rows), key=str)
    assert sum(r[1] > 0 for r in got) > 50


def test_copies_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.9, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (10, [None, 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]),
            (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [3e38, 3e38]), (15, [1e-30, 1e-30])]
    got, rows = run(spark, rows)
    assert got == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.normal(size=(80, 17)))
    coded = list(zip(*embeddings.quantise(x)))
    for i in range(80):
        for j in range(i):
            (q, s, e), (r, t, f) = coded[i], coded[j]
            about = s * t * float(q.astype(float) @ r.astype(float))
            slack = e * t * np.linalg.norm(r.astype(float)) + f * s * np.linalg.norm(q.astype(float)) + e * f
            assert abs(x[i] @ x[j] - about) <= slack


def test_tile_finds_pairs_at_the_threshold():
    """Pairs within a hair of the threshold, on both sides."""
    rng = np.random.default_rng(5)
    base, away = rng.normal(size=(2, 32))
    one = lambda v: embeddings.unit(v[None])[0]
    base = one(base)
    away = one(away - (away @ base) * base)
    near = [0.9 + d for d in (-1e-3, -1e-9, 1e-9, 1e-3)]
    others = [c * base + np.sqrt(1 - c * c) * away for c in near]
    def block(ids, vs):
        codes, scales, errors = embeddings.quantise(np.array(vs))
        return embeddings._block(ids, [1] * len(ids), [v.tobytes() for v in vs], [c.tobytes() for c in codes], scales, errors)
    _, of_left, of_right = embeddings.tile(block([0], [base]), block([1, 2, 3, 4], others), False, 0.9)
    assert of_left.tolist() == [2] and of_right.tolist() == [0, 0, 1, 1]
