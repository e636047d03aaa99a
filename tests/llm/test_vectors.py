"""Operators 1 and 7 against brute force."""

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from quayside.llm import ann, embed_dedup

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [NAN] + [1.0] * 7), (904, [INF] * 8), (905, [1.0] * 5), (920, []), (None, [1.0] * 8)]


def table(spark, x, labels=None, odd=ODD):
    rows = [(k, [float(y) for y in v], None if labels is None else labels[k], "x") for k, v in enumerate(x)]
    rows += [(i, v, 1, "x") for i, v in odd]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(3)


def sample(n, seed=1, size=8):
    order = np.random.default_rng(seed)
    x = order.normal(size=(n, size)) * order.uniform(0.5, 2, (n, 1))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows is one vector
    return x


def nearest(x, top):
    out = {}
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -s))[: min(top, len(x) - 1)]
        out[q] = [(int(k), s[k]) for k in order]
    return out


@pytest.mark.parametrize("n", [3, 400, 3000])
def test_search(spark, store, monkeypatch, n):
    monkeypatch.setattr(ann, "LEAF_ROWS", 200)
    x = sample(n)
    got = {}
    for r in ann.search(table(spark, x), F.col("vec_id") % 20 == 0, store).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest(x, 20)
    assert set(got) == set(want)
    found = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1))
        assert all(abs(score - x[q] @ x[v]) < 1e-9 for _, v, score in rows)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(rows, rows[1:], strict=False))
        least = want[q][-1][1]
        found += sum(score >= least - 1e-9 for _, _, score in rows)
    assert found / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("vectors_of_an_id", [1, 3, 40])
def test_search_counts_ids_not_rows(spark, store, vectors_of_an_id):
    """Every row twice, and one id with several vectors near all queries."""
    order = np.random.default_rng(4)
    rows = [(k, order.normal(size=8)) for k in range(60)]
    rows += [(60, rows[0][1] * (2 + k / 100)) for k in range(vectors_of_an_id)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in rows * 2], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") < 10, store).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(10):
        best = {}
        for k, v in rows:
            if k != q:
                best[k] = max(best.get(k, -INF), float(rows[q][1] @ v))
        want = sorted(best, key=lambda k: (-best[k], k))[:20]
        assert [got[q][i + 1][0] for i in range(20)] == want


def test_search_of_no_rows(spark, store):
    assert rows_of(ann.search(table(spark, []), F.col("vec_id") % 20 == 0, store)) == []
    assert rows_of(ann.search(table(spark, [], odd=[]), F.col("vec_id") % 20 == 0, store)) == []


def test_tree_files_each_point_where_a_walk_ends():
    x = sample(500)
    tree = ann.fit_tree(x, 4, np.random.default_rng(0))
    leaf = tree.leaf_of(x)
    assert set(leaf) == set(range(tree.leaves))
    for k in range(0, 500, 50):
        assert ann.leaves_in_order([tree], x[k], 1) == [(0, leaf[k])]
        assert sorted(x for _, x in ann.leaves_in_order([tree], x[k], 10_000)) == list(range(tree.leaves))


def near_groups(seed=3):
    order = np.random.default_rng(seed)
    base = order.normal(size=(12, 8))
    x = np.concatenate([base[k % 12] + order.normal(size=8) * (0.05 + 0.08 * (k % 7)) for k in range(600)]).reshape(600, 8)
    x[:200] = x[7]  # copies
    return x * order.uniform(0.1, 30, (600, 1)), order.integers(0, 3, 600).tolist()


def test_near_duplicates(spark, store, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LIST_ROWS", 40)
    x, labels = near_groups()
    labels[5] = None
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    known = np.array([y is not None for y in labels])
    same = np.array([[a == b for b in labels] for a in labels]) & known[:, None]
    links = ((u @ u.T) >= 0.93) & same
    np.fill_diagonal(links, False)
    low = np.arange(600)
    i, j = np.nonzero(links)
    for _ in range(600):
        np.minimum.at(low, i, low[j])
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table(spark, x, labels), store).collect()}
    assert len(got) == 600 + len(ODD)
    for k in range(600):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links[k].sum(), low[k], low[k] == k)
    for k, _ in ODD:
        assert (got[k]["n_links"], got[k]["component_id"]) == (0, k)


def test_near_duplicates_of_repeated_ids_and_no_rows(spark, store):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2)]
    got = rows_of(embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), store).orderBy("vec_id"))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert rows_of(embed_dedup.near_duplicates(table(spark, [], odd=[]), store)) == []


def test_no_list_that_may_hold_a_neighbour_is_left_out():
    order = np.random.default_rng(5)
    u = embed_dedup.unit(order.normal(size=(2000, 8)))
    index = embed_dedup.fit(u, 2000 * 20)
    d, own = index.lists(u)
    row, of = index.probes(d, own, 0.5)
    probed = set(zip(row.tolist(), of.tolist(), strict=True))
    a, b = np.nonzero(embed_dedup.distances(u, u) <= 0.25)
    assert all((x, own[y]) in probed for x, y in zip(a.tolist(), b.tolist(), strict=True))
    codes, error = index.encode(u, own)
    tables = index.tables(u[:5], int(own[0]))
    members = np.flatnonzero(own == own[0])
    about = np.sqrt(sum(t[:, codes[members, k]] for k, t in enumerate(tables)))
    true = np.sqrt(embed_dedup.distances(u[:5], u[members]))
    assert (np.abs(about - true) <= error[members][None, :] + 1e-9).all()


def test_vectors_of_two_lengths(spark, store):
    """Vectors of a rarer length link and are searched among each other."""
    x = sample(60)
    rows = [(k, v.tolist(), 1, "x") for k, v in enumerate(x)] + [(100, [1.0, 2.0, 3.0], 1, "x"), (101, [1.0, 2.0, 3.0], 1, "x"), (120, [3.0, 2.0, 1.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, store).collect()}
    assert (got[100], got[101], got[120]) == ((1, 100), (1, 100), (0, 120))
    found = sorted(r for r in rows_of(ann.search(df, F.col("vec_id") % 20 == 0, store)) if r[0] >= 100)
    assert [(q, place, v, s) for q, place, v, s in found] == [(100, 1, 101, 14.0), (100, 2, 120, 10.0), (120, 1, 100, 10.0), (120, 2, 101, 10.0)]
    assert {r[0] for r in rows_of(ann.search(df, F.col("vec_id") % 20 == 0, store))} == {0, 20, 40, 100, 120}


@pytest.mark.parametrize("exact", [False, True])
def test_few_lists_hold_the_links(spark, store, monkeypatch, exact):
    """Vectors in single precision around random ones: links found against all, and how many lists that takes."""
    monkeypatch.setattr(embed_dedup, "LIST_ROWS", 50)
    order = np.random.default_rng(9)
    base = order.normal(size=(1000, 64))
    x = np.concatenate([base, base + order.normal(size=base.shape) * 0.25, base[:900] + order.normal(size=(900, 64)) * 0.33, base[:100]]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, store, exact=exact).collect()}
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= (1 if exact else 0.97) * links.sum() > 0
    index = embed_dedup.fit(u, len(x))
    assert len(index.centroids) == 60 and index.looked_into <= 20
