"""Operator 1: nearest neighbours by a forest of random-projection trees.

The trees are fitted to a bounded sample: a node parts its vectors at the median of their projections on
the line through two of them. Every vector is then filed in one leaf of each tree. A query walks all
trees through one priority queue, always opening the branch that it misses by the least, until it has
seen as many leaves as the fit found necessary: those that bring ``RECALL`` of the true neighbours
of sample queries among the sample. The vectors of these leaves are scored exactly.

For the largest inner product, vectors get one more component that gives them all the same length; a query
gets zero there, so that near means a large product. Leaves meet their queries block by block."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm import vectors
from quayside.llm.common import Store

TREES = 4
LEAF_ROWS = 4096  # rows a leaf should hold; a fuller one is several blocks
SAMPLE = 16_384
LEAST_IN_NODE = 16
RECALL = 0.97
HELD = 1 << 19  # found rows that a task holds before it thins them out


@dataclass
class Tree:
    """Nodes as arrays; ``below[i]`` are the children (below, above the threshold), -leaf - 1 for a leaf."""

    normals: np.ndarray
    thresholds: np.ndarray
    below: np.ndarray
    leaves: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if len(self.normals) else np.full(len(points), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            above = np.einsum("ij,ij->i", points[open_], self.normals[node]) > self.thresholds[node]
            at[open_] = self.below[node, above.astype(int)]
        return -at - 1


def fit_tree(points: np.ndarray, depth: int, order: np.random.Generator) -> Tree:
    normals, thresholds, below, leaves = [], [], [], 0

    def part(rows: np.ndarray, level: int) -> int:
        nonlocal leaves
        if level < depth and len(rows) >= 2 * LEAST_IN_NODE:
            for _ in range(3):
                a, b = points[order.choice(rows, 2, replace=False)]
                if (length := np.linalg.norm(a - b)) > 1e-9:
                    projected = points[rows] @ ((a - b) / length)
                    cut = float(np.median(projected))
                    above = projected > cut
                    if LEAST_IN_NODE <= above.sum() <= len(rows) - LEAST_IN_NODE:
                        node = len(normals)
                        normals.append((a - b) / length)
                        thresholds.append(cut)
                        below.append([0, 0])
                        below[node] = [part(rows[~above], level + 1), part(rows[above], level + 1)]
                        return node
        leaves += 1
        return -leaves

    part(np.arange(len(points)), 0)
    return Tree(np.array(normals).reshape(len(normals), points.shape[1]), np.array(thresholds), np.array(below, np.int64).reshape(-1, 2), leaves)


def leaves_in_order(forest: list[Tree], query: np.ndarray, most: int) -> list[tuple[int, int]]:
    """``(tree, leaf)`` by the least distance a query would have to move to fall into it; ties by tree."""
    sides = [(t.normals @ query - t.thresholds).tolist() if len(t.normals) else [] for t in forest]
    waiting = [(0.0, i, 0 if len(t.normals) else -1) for i, t in enumerate(forest)]
    heapq.heapify(waiting)
    found: list[tuple[int, int]] = []
    while waiting and len(found) < most:
        missed, i, node = heapq.heappop(waiting)
        if node < 0:
            found.append((i, -node - 1))
            continue
        side, (low, high) = sides[i][node], forest[i].below[node].tolist()
        heapq.heappush(waiting, (max(missed, side), i, low))
        heapq.heappush(waiting, (max(missed, -side), i, high))
    return found


def lifted(points: np.ndarray, length: float) -> np.ndarray:
    """Points with a last component that brings them to ``length``."""
    rest = np.sqrt(np.maximum(length**2 - (points**2).sum(axis=1), 0))
    return np.concatenate([points, rest[:, None]], axis=1)


def fit(points: np.ndarray, rows: int, top: int, recall: float = RECALL, trees: int = TREES, seed: int = 11) -> tuple[list[Tree], int]:
    """The forest for ``rows`` vectors of which ``points`` (lifted) are a sample, and how many leaves to see."""
    order = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(1, rows / LEAF_ROWS)))))
    forest = [fit_tree(points, depth, order) for _ in range(trees)]
    total = sum(t.leaves for t in forest)
    asked = order.choice(len(points), min(len(points), 256), replace=False)
    filed = np.stack([t.leaf_of(points) for t in forest])
    first = np.cumsum([0, *[t.leaves for t in forest]])
    steps = np.zeros(total + 1)
    for q in asked:
        query = points[q].copy()
        query[-1] = 0
        score = points @ query
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(top, len(points) - 1)]
        step = np.full(total, total)
        for k, (i, leaf) in enumerate(leaves_in_order(forest, query, total)):
            step[first[i] + leaf] = k + 1
        np.add.at(steps, np.min([step[first[i] + filed[i, near]] for i in range(len(forest))], axis=0), 1)
    if not steps.sum():
        return forest, total
    return forest, int(np.searchsorted(np.cumsum(steps) / steps.sum(), recall))


def search(table: DataFrame, is_query: F.Column, store: Store, top: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of largest inner product found for each query.

    ``table`` has ``vec_id, embedding``; queries are the rows where ``is_query`` holds, candidates all rows
    of another id and as many components. Vectors that are null, zero, or hold null or non-finite components, and
    rows without an id, take no part. Each number of components has a forest of its own. Equal rows count once; if an id has several vectors, each is a
    candidate and the id's best one counts, and each is asked. Equal scores go to the smaller id.
    An empty table gives none; with fewer candidates a query gets them all. Other columns are dropped."""
    good = table.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asked")).where(F.col("vec_id").isNotNull() & vectors.usable("embedding"))
    rows = vectors.packed(good.select("vec_id", "asked", F.size("embedding").alias("size"), "embedding"), "embedding")
    rows = store.keep(rows.groupBy("size", "vec_id", "v").agg(F.max("asked").alias("asked")), "vectors")
    found = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    for of in rows.groupBy("size").agg(F.count("*").alias("n"), F.max("asked").alias("asked")).collect():  # a row for each number of components
        if of["asked"]:
            found = found.unionByName(_search(rows.where(F.col("size") == of["size"]), of["size"], of["n"], top, recall))
    return found


def _search(rows: DataFrame, size: int, n: int, top: int, recall: float) -> DataFrame:
    names = "query_id long, vec_id long, score double"
    points = vectors.sample(rows, SAMPLE, size)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors.matrix(batch.column(0).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((v**2).sum(axis=1).max(initial=0)))])], ["x"])

    length = rows.select("v").mapInArrow(longest, "x double").agg(F.max("x")).first()[0]
    forest, most = fit(lifted(points, length), n, top, recall)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = lifted(vectors.matrix(batch.column(1).to_pylist(), size), length)
            for i, tree in enumerate(forest):
                leaf = pa.array(i << 32 | tree.leaf_of(v))
                yield pa.RecordBatch.from_arrays([leaf, *batch.columns], ["leaf", "vec_id", "v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors.matrix(batch.column(1).to_pylist(), size)
            seen = [[i << 32 | leaf for i, leaf in leaves_in_order(forest, np.append(x, 0.0), most)] for x in v]
            owner = pa.array(np.repeat(np.arange(len(seen)), [len(x) for x in seen]))
            yield pa.RecordBatch.from_arrays([pa.array([y for x in seen for y in x], pa.int64()), *[c.take(owner) for c in batch.columns]], ["leaf", "vec_id", "v"])

    kind = "leaf long, vec_id long, v binary"
    held = vectors.blocks(rows.select("vec_id", "v").mapInArrow(filed, kind), ["leaf"], ["vec_id", "v"], "held", LEAF_ROWS)
    sought = vectors.blocks(rows.where("asked").select("vec_id", "v").mapInArrow(asked, kind), ["leaf"], ["vec_id", "v"], "sought", 512)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        waiting, n = [kept], 0
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(batch.schema.get_field_index(x)) for x in ("held", "sought")]
                (ids, v), (asking, q) = [(np.asarray(vectors.column(x, i, "vec_id")), vectors.matrix(vectors.column(x, i, "v").to_pylist(), size)) for x in sides]
                waiting.append(_best(ids, v, asking, q, top))
                n += len(waiting[-1][0])
                if n > HELD:  # a query's best rows of all leaves seen so far
                    kept = _leading([np.concatenate(x) for x in zip(*waiting, strict=True)], top)
                    waiting, n = [kept], 0
                    if len(kept[0]) > HELD:
                        yield _rows(kept)
                        waiting = []
        if waiting:
            yield _rows(_leading([np.concatenate(x) for x in zip(*waiting, strict=True)], top))

    joined = held.join(sought, "leaf").select("held", "sought").mapInArrow(best, names)
    ranked = joined.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _best(ids: np.ndarray, v: np.ndarray, asking: np.ndarray, q: np.ndarray, top: int) -> list[np.ndarray]:
    """Rows of each query's best ids of a block, by exact products; products that may tie stay in until then."""
    rough = q @ v.T
    rough[asking[:, None] == ids[None, :]] = -np.inf
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    of_ids = rough if len(starts) == len(ids) else np.maximum.reduceat(rough[:, order], starts, axis=1)
    owner, near = [], []
    for k in range(len(asking)):
        least = np.partition(of_ids[k], -top)[-top] if len(starts) > top else -np.inf
        near.append(np.flatnonzero(rough[k] >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else rough[k] > -np.inf))
        owner.append(np.full(len(near[-1]), k))
    owner, near = np.concatenate(owner), np.concatenate(near)
    exact = np.concatenate([(v[near[k : k + 65536]] * q[owner[k : k + 65536]]).sum(axis=1) for k in range(0, len(near), 65536)] or [np.zeros(0)])
    return _leading([asking[owner], ids[near], exact], top)


def _leading(rows: list[np.ndarray], top: int) -> list[np.ndarray]:
    """The best ``top`` ids of each query, an id with its best score."""
    asked, ids, score = rows
    order = np.lexsort((-score, ids, asked))
    asked, ids, score = asked[order], ids[order], score[order]
    new = np.ones(len(asked), bool)
    new[1:] = (asked[1:] != asked[:-1]) | (ids[1:] != ids[:-1])
    asked, ids, score = asked[new], ids[new], score[new]
    order = np.lexsort((ids, -score, asked))
    asked, ids, score = asked[order], ids[order], score[order]
    first = np.searchsorted(asked, asked)  # where each query's rows begin
    kept = np.arange(len(asked)) - first < top
    return [asked[kept], ids[kept], score[kept]]


def _rows(rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])
