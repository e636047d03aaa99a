"""Operator 11: exact centroid clustering over blocks of near vectors.

Vectors become integers and are put in the order of a Hilbert curve through their widest components; runs of
them are stored as blocks, one row a block, with the least and greatest value of every component (a zone
map). A centroid is no candidate of a block if another one is nearer to every point of the block's box: over a box, the difference
of two squared distances is linear in each component, so its greatest value is a sum over the box's ends.
What is left is compared exactly, in integers, with all vectors of the block at once. Rounds exchange sums of the
clusters only; vectors never move after the blocks are written."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Store
from quayside.llm.vectors import packed

SCALE = 1024
CLUSTERS, ROUNDS, SIZE = 8, 10, 64
BLOCK_ROWS = 1024
#: The curve runs through so many of the components, in cells of so many bits.
CURVE_COMPONENTS, CURVE_BITS = 12, 4
#: Integer components up to this keep every distance and difference of distances within 64 bits.
MOST = 1 << 26

Centroids = list[list[int]]


@dataclass
class Clusters:
    """The result: a row a vector, the centroids, and how many comparisons the boxes saved."""

    members: DataFrame  # vec_id, cluster, distance
    centroids: Centroids
    inertias: dict[int, int]
    compared: list[tuple[int, int]] = field(default_factory=list)  # by round: distances computed, distances of the plain method


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers (``bits`` bits each, 64 in all at most)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the turns and reflections of each level
        low = level - 1
        for i in range(n):
            set_ = (x[i] & level) != 0
            swapped = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swapped)
            if i:
                x[i] ^= swapped
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[-1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def candidates(low: np.ndarray, high: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Centroids that may be the first nearest one of a point of the box.

    ``j`` rules out ``i`` if ``d(x, j) - d(x, i)`` is negative over the whole box, or nowhere positive and ``j`` comes first."""
    norms = (c * c).sum(axis=1)
    turned = 2 * (c[:, None, :] - c[None, :, :])  # [j, i]: d(x, j) - d(x, i) = -turned . x + norms[j] - norms[i]
    greatest = np.maximum(-turned * low, -turned * high).sum(axis=2) + norms[:, None] - norms[None, :]
    number = np.arange(len(c))
    out = (greatest < 0) | ((greatest <= 0) & (number[:, None] < number[None, :]))
    return np.flatnonzero(~out.any(axis=0))


def nearest(v: np.ndarray, c: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of the centroids ``of``, and the squared distance to it."""
    d = np.stack([((v - c[k]) ** 2).sum(axis=1) for k in of], axis=1)
    at = d.argmin(axis=1)
    return of[at], d[np.arange(len(v)), at]


def integers(table: DataFrame, size: int = SIZE) -> DataFrame:
    """``vec_id, embedding``: vectors of ``size`` finite components as whole numbers ``floor(1024 x)`` (in doubles).

    Vectors with a component of more than ``MOST / 1024`` (65,536) either way take no part: their distances do not fit 64 bits."""
    x = F.col("embedding")
    fit = (F.size(x) == size) & ~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y.cast("double")) > MOST / SCALE))
    good = table.where(F.coalesce(fit, F.lit(False)))
    scaled = F.transform(x, lambda y: F.floor(y.cast("double") * SCALE).cast("double"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("embedding"))


def unpacked(values: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<f8").reshape(len(values), size).astype(np.int64)


def blocked(vectors: DataFrame, store: Store, size: int = SIZE, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks along the curve: ``n, ids, v, low, high`` (packed). Equal vectors may be any number: ties are dealt by a hash."""

    def spread_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares, low, high = 0, np.zeros(size), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            if batch.num_rows:
                v = unpacked(batch.column(0), size)
                n, total, squares = n + len(v), total + v.sum(axis=0), squares + (v.astype(float) ** 2).sum(axis=0)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        if n:
            at = np.arange(size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, np.full(size, float(n)), total, squares, low, high)], ["at", "n", "total", "squares", "low", "high"])

    kind = "at long, n double, total double, squares double, low double, high double"
    spans = vectors.select("v").mapInArrow(spread_of, kind).groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    wide = spans.orderBy(F.desc(F.col("s") - F.col("t") * F.col("t") / F.col("n")), "at").limit(CURVE_COMPONENTS).collect()  # a bounded number of rows
    at = np.array([r["at"] for r in wide], dtype=int)
    low, high = np.array([r["low"] for r in wide]), np.array([r["high"] for r in wide])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = 1 << CURVE_BITS
        for batch in batches:
            v = unpacked(batch.column(1), size)[:, at]
            cell = np.clip((v - low) * cells // np.maximum(high - low + 1, 1), 0, cells - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cell, CURVE_BITS))], ["vec_id", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of at most ``rows`` rows, in order
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                v = unpacked(part.column(1), size)
                ids = [None if x is None else int(x) for x in part.column(0).to_pylist()]
                columns = [[len(v)], [ids], [v.astype("<i4").tobytes()], [v.min(axis=0).astype("<i4").tobytes()], [v.max(axis=0).astype("<i4").tobytes()]]
                kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "ids", "v", "low", "high"])

    ordered = vectors.mapInArrow(placed, "vec_id long, v binary, place long").withColumn("tie", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "place", "tie").sortWithinPartitions("place", "tie").select("vec_id", "v")
    return store.keep(ordered.mapInArrow(cut, "n int, ids array<long>, v binary, low binary, high binary"), "blocks")


def starts(whole: DataFrame, clusters: int = CLUSTERS) -> Centroids:
    """The vectors with the lowest sha256 of ``3:<vec_id>``; of rows of one id the lower by components. Null ids start nothing."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = whole.where("vec_id is not null").select(key.alias("k"), "embedding").orderBy("k", "embedding").limit(clusters).collect()
    return [v for _, v in sorted((r["k"], [int(x) for x in r["embedding"]]) for r in rows)]


def assigned(batch: pa.RecordBatch, c: np.ndarray, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each block: ids, vectors, their clusters, their distances, and the number of candidates."""
    column = {name: batch.column(batch.schema.get_field_index(name)) for name in ("ids", "v", "low", "high")}
    for i in range(batch.num_rows):
        v, low, high = (np.frombuffer(column[x][i].as_py(), "<i4").astype(np.int64).reshape(-1, size) for x in ("v", "low", "high"))
        of = candidates(low[0], high[0], c)
        own, distance = nearest(v, c, of)
        yield column["ids"].slice(i, 1).flatten(), v, own, distance, len(of)


def improved(blocks: DataFrame, centroids: Centroids, size: int = SIZE) -> tuple[Centroids, tuple[int, int]]:
    """The centroids after one round, and how many distances it took of how many. A row for each cluster reaches the driver."""
    c = np.array(centroids, np.int64).reshape(-1, size)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, compared = np.zeros_like(c), np.zeros(len(c), np.int64), 0
        for batch in batches:
            for _, v, own, _, tried in assigned(batch, c, size):
                n += np.bincount(own, minlength=len(c))
                compared += tried * len(v)
                for k in np.unique(own):
                    sums[k] += v[own == k].sum(axis=0)
        some = np.flatnonzero(n)
        took = [compared if k == (some[0] if len(some) else -1) else 0 for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(took, pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "took", "sums"])

    parts = blocks.mapInArrow(summed, "cluster int, n long, took long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("took").alias("took"), F.array(*total).alias("sums")).collect()
    moved = list(centroids)
    for r in rows:
        moved[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return moved, (sum(r["took"] for r in rows), sum(r["n"] for r in rows) * len(centroids))


def cluster(table: DataFrame, store: Store, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> Clusters:
    """k-means of ``table(vec_id, embedding)`` in integers; every round takes all vectors."""
    whole = integers(table, size)
    centroids = starts(whole, clusters)
    blocks = blocked(store.keep(packed(whole, "embedding"), "vectors"), store, size)
    compared = []
    if centroids:
        for _ in range(rounds):
            centroids, took = improved(blocks, centroids, size)
            compared.append(took)
    c = np.array(centroids, np.int64).reshape(-1, size)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, own, distance, _ in assigned(batch, c, size) if len(c) else ():
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    members = store.keep(blocks.mapInArrow(told, "vec_id long, cluster int, distance long"), "members")
    sums = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row a cluster
    return Clusters(members, centroids, {r["cluster"]: int(r["inertia"]) for r in sums}, compared)


def digest(found: Clusters) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors that are null, not of 64 components, or hold null or non-finite components or ones beyond 65,536 take no part. Rows that repeat
    an id, or a vector, are vectors of their own; rows without an id are clustered but start no centroid. With fewer vectors than
    centroids wanted there are fewer centroids; without any, no rows. Other columns are dropped. A sum beyond 64 bits is an error."""
    k = range(max(1, len(found.centroids)))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids] or [None]
    of_cluster = F.array(*[F.lit(found.inertias.get(i, 0)).cast("long") for i in k])
    return found.members.select(
        "vec_id", "cluster", "distance", of_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(found.inertias.values())).cast("long").alias("inertia"), F.array(*[F.lit(h).cast("string") for h in hashes])[F.col("cluster")].alias("centroid_sha256"),
    )
