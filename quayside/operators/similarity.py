"""Nearest vectors for a table of queries.

Vectors stay where they are: every task multiplies its Arrow batches with the query
matrix, ``TURN`` queries at a time, and keeps the k best per query, so k rows per query leave a task and
no pair is ever materialised. The matrix holds up to ``BLOCK`` queries (fewer of many components: ``MATRIX`` bytes),
so one job answers them; a larger query table is worked off block by block, each block's result going to a table
in shared storage."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.session import shared_dir

CANDIDATES = 20
BLOCK = 1 << 17  # queries in one job
MATRIX = 256 << 20  # bytes of the matrix that is sent to each executor
TURN = 1024  # queries multiplied with a batch at a time
FITTED = 20_000
RECALL, ASKED = 0.95, 512  # recall that the number of probes is chosen for, and sample queries it is measured on
DIGITS = 9  # scores that agree this far are ties, decided by id


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where a vector is missing or zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores (ties: lowest id first)."""
    if len(ids) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= bar
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _scan(vectors: DataFrame, key: str, embedding: str, query_ids: list[str], matrix: np.ndarray, k: int,
          cells: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """k best vectors per query and task; with ``cells`` only vectors of probed cells."""
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, _unit(matrix), None if cells is None else cells[1]))
    cell_column = None if cells is None else cells[0]

    def best_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, probes = shared.value
        kept: list[tuple | None] = [None] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0).to_pylist())  # numbers or strings
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            units = _unit(rows.reshape(batch.num_rows, -1).astype(np.float64)).T
            where = None if cell_column is None else batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(len(names)):
                if i % TURN == 0:
                    scores = np.round(queries[i : i + TURN] @ units, DIGITS)
                found, value = ids, scores[i % TURN]
                if where is not None:
                    probed = np.isin(where, probes[i])
                    found, value = found[probed], value[probed]
                if kept[i] is not None:
                    found, value = np.concatenate([kept[i][0], found]), np.concatenate([kept[i][1], value])
                kept[i] = _best(found, value, k)
        told = [i for i, best in enumerate(kept) if best is not None and len(best[0])]
        for start in range(0, len(told), TURN):
            some = told[start : start + TURN]
            name = pa.array([names[i] for i in some], pa.string()).take(pa.array(np.repeat(np.arange(len(some)), [len(kept[i][0]) for i in some])))
            columns = [pa.array([x for i in some for x in kept[i][0].tolist()], kind), pa.array(np.concatenate([kept[i][1] for i in some]))]
            yield pa.RecordBatch.from_arrays([name, *columns], ["query", key, "similarity"])

    columns = [F.col(key), F.col(embedding)] + ([F.col(cell_column)] if cell_column else [])
    # A vector of another length can't be compared; it is no result.
    usable = vectors.filter(F.size(embedding) == matrix.shape[1]).select(*columns)
    key_type = vectors.schema[key].dataType
    kind = pa.string() if isinstance(key_type, T.StringType) else pa.int64() if isinstance(key_type, T.LongType) else pa.int32()
    return usable.mapInArrow(best_per_task, f"query string, `{key}` {key_type.simpleString()}, similarity double")


def _top(scored: DataFrame, key: str, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _matrix(rows) -> tuple[list[str], np.ndarray]:
    """Ids and vectors of the queries; those that are not of the usual length find nothing."""
    lengths = Counter(len(r[1]) for r in rows)
    size = lengths.most_common(1)[0][0] if rows else 0
    rows = [r for r in rows if len(r[1]) == size]
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), size)


def in_blocks(queries: DataFrame, query: list[str], asked: str, block: int, search: Callable[[list], DataFrame]) -> DataFrame:
    """Search with all queries at once if they are few, else block by block into a table.

    ``search`` gets rows of (key, what is asked) without nulls. The key columns of a query travel as one JSON text, in column
    ``query`` of what it returns, and are taken apart again."""
    found = _found(queries, query, asked, block, search)
    types = ", ".join(f"`{q}` {queries.schema[q].dataType.simpleString()}" for q in query)
    parts = found.withColumn("_key", F.from_json("query", types))
    return parts.select(*[F.col(f"_key.`{q}`").alias(q) for q in query], *[c for c in found.columns if c != "query"])


def _found(queries: DataFrame, query: list[str], asked: str, block: int, search) -> DataFrame:
    spark = queries.sparkSession
    key = F.to_json(F.struct(*query), {"ignoreNullFields": "false"})
    wanted = queries.select(key.alias("query"), F.col(asked).alias("e")).filter("e is not null")
    one = wanted.limit(1).collect()
    block = max(2, min(block, MATRIX // (8 * max(1, len(one[0]["e"]))))) if one else block
    first = wanted.limit(block + 1).collect()
    if len(first) <= block:
        return search(first)
    blocks = -(-wanted.count() // (block // 2))
    numbered = wanted.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    target = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for number in range(blocks):
        rows = numbered.filter(F.col("_b") == number).drop("_b").collect()
        if rows:
            search(rows).write.mode("overwrite").parquet(f"{target}/block={number}")
    return spark.read.parquet(target).drop("block")


def vector_search(queries: DataFrame, vectors: DataFrame, key: str, k: int = CANDIDATES, *,
                  query: str | list[str] = "query", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Exact: the k most similar vectors per query as (query, key, similarity, rank).

    ``query`` names the column, or the columns, that identify a query; ids are numbers or strings."""
    return in_blocks(queries, [query] if isinstance(query, str) else query, embedding, block, lambda rows: _top(
        _scan(vectors, key, embedding, *_matrix(rows), k), key, k))


def _probes(points: np.ndarray, cell: np.ndarray, centres: np.ndarray, k: int, seed: int) -> int:
    """How many cells to read for ``RECALL`` of the ``k`` nearest of some of the points among the others."""
    asked = np.random.default_rng(seed).permutation(len(points))[:ASKED]
    steps = np.zeros(len(centres) + 1)
    for q in asked:
        score = points @ points[q]
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(points) - 1)]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ points[q]), kind="stable")] = np.arange(len(centres))
        np.add.at(steps, place[cell[near]] + 1, 1)
    if not steps.sum():
        return len(centres)
    return int(np.searchsorted(np.cumsum(steps) / steps.sum(), RECALL))


def approx_vector_search(queries: DataFrame, vectors: DataFrame, key: str, k: int = CANDIDATES, *, cells: int | None = None,
                         probes: int | None = None, query: str = "query", embedding: str = "embedding", seed: int = 7,
                         block: int = BLOCK) -> DataFrame:
    """Approximate: vectors are stored by cell, and a query reads its nearest cells only.

    Without ``cells`` there are as many as the root of the number of vectors; without ``probes`` so many of them are
    read that sample queries find ``RECALL`` of their true neighbours among the sample. With ``probes`` equal to ``cells`` the result is exact. The cells' centres are
    fitted to at most ``FITTED`` vectors, those of the lowest hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    unit = Normalizer(inputCol="_v", outputCol="_u", p=2.0)
    usable = vectors.filter(F.col(embedding).isNotNull()).select(key, embedding)
    cells = cells or max(1, round(usable.count() ** 0.5))
    points = unit.transform(usable.withColumn("_v", array_to_vector(embedding))).drop("_v")
    fitted = points.orderBy(F.xxhash64(key), key).limit(FITTED)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_u", predictionCol="cell").fit(fitted)
    folder = f"{shared_dir(vectors.sparkSession)}/cells-{uuid.uuid4().hex}"
    model.transform(points).drop("_u").repartition("cell", F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("cell").parquet(folder)
    placed = vectors.sparkSession.read.parquet(folder)
    centres = _unit(np.array(model.clusterCenters()))
    if not probes:
        sampled = model.transform(fitted).select("cell", "_u").collect()
        probes = _probes(np.array([r["_u"].toArray() for r in sampled]), np.array([r["cell"] for r in sampled]), centres, k, seed)

    def search(rows: list) -> DataFrame:
        ids, matrix = _matrix(rows)
        probed = np.argsort(-(_unit(matrix) @ centres.T), axis=1, kind="stable")[:, :probes]
        read = placed.filter(F.col("cell").isin(np.unique(probed).tolist()))  # whole folders are skipped
        return _top(_scan(read, key, embedding, ids, matrix, k, ("cell", probed)), key, k)

    return in_blocks(queries, [query], embedding, block, search)
