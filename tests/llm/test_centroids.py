"""Operator 11 against k-means in plain Python numbers."""

import hashlib

import numpy as np
import pytest
from helpers import clashing, rows_of

from quayside.llm import centroids

NAN, INF = float("nan"), float("inf")


def plain(rows, clusters=8, rounds=10):
    """``rows`` of (id, components); every step over all of them, one at a time."""
    v = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), e) for i, e in v if i is not None)[:clusters]
    c = [list(e) for _, e in start]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), k) for k, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(e)[1] for _, e in v]
        for k in range(len(c)):
            mine = [e for (_, e), o in zip(v, own, strict=True) if o == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [(i, *nearest(e)) for i, e in v]
    of = [sum(d for _, d, o in last if o == k) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, d, of[k], sum(of), sha[k]) for i, d, k in last), key=str)


def table(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 5, 600])
def test_equals_plain_k_means(spark, store, n):
    order = np.random.default_rng(n)
    x = order.normal(size=(n, 64)) * 0.2 + order.integers(0, 4, n)[:, None]
    x[n // 2 : n // 2 + n // 3] = x[0] if n else 0  # a third of all rows is one vector
    rows = [(k, e.tolist()) for k, e in enumerate(x)]
    odd = [(900, None), (901, [1.0] * 63), (902, [None, *[1.0] * 63]), (903, [NAN] + [1.0] * 63), (904, [INF] * 64), (905, []), (906, [1e9] * 64)]
    again = rows[:20] + [(3, [0.25] * 64)] * (n > 3) + [(None, [0.5] * 64)] * (n > 0)
    got = centroids.digest(centroids.cluster(table(spark, rows + again + odd), store))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(rows_of(got), key=str) == plain(rows + again)


def test_only_rows_without_vectors(spark, store):
    assert rows_of(centroids.digest(centroids.cluster(table(spark, [(1, None), (None, [1.0])]), store))) == []


def test_ties_go_to_the_smaller_number():
    c = np.array([[0, 0], [2, 0], [1, 1], [0, 0]])
    for low, high in (([1, 0], [1, 0]), ([0, 0], [2, 0]), ([1, -5], [1, 0])):
        of = centroids.candidates(np.array(low), np.array(high), c)
        points = np.array([[x, y] for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)])
        own, d = centroids.nearest(points, c, of)
        for p, o, e in zip(points, own, d, strict=True):
            assert (e, o) == min((int(((p - x) ** 2).sum()), k) for k, x in enumerate(c))
        assert 3 not in of


def test_boxes_rule_out_only_what_is_never_nearest():
    order = np.random.default_rng(2)
    left = 0
    for _ in range(200):
        c = order.integers(-50, 50, (8, 5))
        low = order.integers(-50, 50, 5)
        high = low + order.integers(0, 20, 5)
        of = centroids.candidates(low, high, c)
        points = order.integers(low, high + 1, (200, 5))
        everything = centroids.nearest(points, c, np.arange(8))
        assert (np.stack(centroids.nearest(points, c, of)) == np.stack(everything)).all()
        left += len(of)
    assert left < 200 * 5


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_the_curve_steps_to_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
    place = centroids.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    walked = cells[np.argsort(place)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_blocks_save_comparisons(spark, store):
    order = np.random.default_rng(5)
    x = order.normal(size=(4000, 64)) * 0.05 + order.integers(0, 8, 4000)[:, None] * np.linspace(-1, 1, 64)
    found = centroids.cluster(table(spark, [(k, e.tolist()) for k, e in enumerate(x)]), store)
    assert sum(a for a, _ in found.compared) < 0.7 * sum(b for _, b in found.compared)
