"""Operator 7: near-duplicate vectors by product quantisation.

Equal vectors of a label are one row with a count. Unit vectors go to the nearest of some coarse centroids; what
is left is coded by subspaces. A vector looks into its nearest lists, so many that ``RECALL`` of sampled vectors, moved in a
random direction until their cosine is just the least one, are in a list that they look into; with ``exact`` into all lists that may hold
a vector within ``reach`` by the distance from their border. In a list, a table of distances from the vector to the codes
of each subspace gives its distance to a coded vector, which differs from the true one by no more than the
stored coding error. What may be near enough by that bound gets the exact cosine. Blocks of a list
meet blocks of the vectors that look into it; they give counts and a spanning forest of the links found, never the pairs.

Centroids, codes and the number of lists are fitted to a bounded sample, for each number of components apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import vectors
from quayside.llm.common import Store, components

LEAST_COSINE = 0.93
SAMPLE = 16_384
LIST_ROWS = 512
MOST_LISTS = 1024
RECALL = 0.98
SUBSPACES, CODES = 8, 64
SENT = 4096  # rows in a batch of vectors that look into lists
PAIRS = 1 << 16  # candidate pairs whose exact cosine is taken at a time


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]  # codes of each subspace
    parts: list[slice]
    looked_into: int  # lists, of those nearest to a vector

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids, and the nearest one (of equals the first)."""
        d = distances(unit, self.centroids)
        return d, d.argmin(axis=1)

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave."""
        rest = unit - self.centroids[own]
        codes = np.stack([distances(rest[:, p], b).argmin(axis=1) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(axis=1))

    def nearest(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, list)`` of the lists that a row looks into."""
        most = min(self.looked_into, d.shape[1])
        of = np.argpartition(d, most - 1, axis=1)[:, :most]
        return np.repeat(np.arange(len(d)), most), of.ravel()

    def probes(self, d: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, list)`` of every list that can hold a vector within ``reach`` of the row's."""
        between = np.sqrt(np.maximum(distances(self.centroids, self.centroids), 0))
        rows = np.arange(len(own))
        near = (d - d[rows, own][:, None]) / 2 <= (reach + 1e-6) * between[own] + 1e-9
        return np.nonzero(near)

    def tables(self, unit: np.ndarray, of: int) -> list[np.ndarray]:
        """Squared distances of each vector's residual in list ``of`` to the codes, by subspace."""
        rest = unit - self.centroids[of]
        return [distances(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0)


def means(points: np.ndarray, k: int, order: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means from distinct points; an empty cluster keeps its centre."""
    distinct = np.unique(points, axis=0)
    centres = distinct[order.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def lists_needed(unit: np.ndarray, centroids: np.ndarray, least: float, order: np.random.Generator) -> int:
    """How many of its nearest lists a vector has to look into to meet ``RECALL`` of neighbours at a cosine of ``least``."""
    if unit.shape[1] < 2 or least >= 1:
        return 1
    turned = order.normal(size=unit.shape)
    turned -= (turned * unit).sum(axis=1, keepdims=True) * unit
    turned /= np.maximum(np.sqrt((turned**2).sum(axis=1, keepdims=True)), 1e-300)
    neighbour = least * unit + np.sqrt(1 - least**2) * turned
    d, held = distances(unit, centroids), distances(neighbour, centroids).argmin(axis=1)
    rank = (d < d[np.arange(len(d)), held][:, None]).sum(axis=1)
    return int(np.quantile(rank, RECALL, method="higher")) + 1


def fit(unit: np.ndarray, rows: int, least: float = LEAST_COSINE, seed: int = 5) -> Index:
    order = np.random.default_rng(seed)
    centroids = means(unit, int(np.clip(rows // LIST_ROWS, 1, MOST_LISTS)), order)
    rest = unit - centroids[distances(unit, centroids).argmin(axis=1)]
    size = unit.shape[1]
    cuts = np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Index(centroids, [means(rest[:, p], CODES, order) for p in parts], parts, lists_needed(unit, centroids, least, order))


def near_duplicates(table: DataFrame, store: Store, least: float = LEAST_COSINE, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every id of ``table(vec_id, embedding, label)``.

    Vectors of equal, non-null label and as many components link at a cosine of ``least`` (positive) or more, in double
    precision. Vectors that are null, zero or hold null or non-finite components, and those without a label, link with
    nothing. Equal vectors always link; other links are those found in the lists looked into, or all with ``exact``. Rows that repeat an id
    are one vector: the lowest by label and components. Rows without an id are one row of a null id, without links. ``kept``
    is whether the id is the smallest of its component. Other columns are dropped."""
    one = (
        table.select(F.col("vec_id").cast("long"), "label", "embedding")
        .groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_x"))
        .select("vec_id", "_x.label", "_x.embedding")
    )
    good = one.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable("embedding"))
    # Two hashes tell the vectors of a label apart: 128 bits.
    keyed = good.select("vec_id", "label", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g"), "embedding")
    keyed = store.keep(vectors.packed(keyed, "embedding", as_given=True), "vectors")
    classes = store.keep(keyed.groupBy("label", "size", "h", "g").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")), "classes")
    rows = store.keep(keyed.join(classes.select(F.col("class").alias("vec_id"), "n"), "vec_id").select("vec_id", "label", "size", "v", "n"), "distinct")
    found = None
    for of in rows.groupBy("size").count().collect():  # a row for each number of components
        links = _found_links(rows.where(F.col("size") == of["size"]), of["size"], of["count"], store, least, exact)
        found = links if found is None else found.unionByName(links)
    ids = one.select("vec_id")
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"), store)
    told = (
        classes.join(counts, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
        .select("label", "size", "h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    )
    linked = keyed.select("vec_id", "label", "size", "h", "g").join(told, ["label", "size", "h", "g"]).select("vec_id", "n_links", "component_id")
    return (
        ids.join(linked, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _found_links(rows: DataFrame, size: int, n: int, store: Store, least: float, exact: bool) -> DataFrame:
    """Stored ``(a, b, n)`` of distinct vectors of one size: counts where ``b`` is null, else edges of spanning forests."""
    index = fit(unit(vectors.matrix([r["v"] for r in _sampled(rows, size)], size)), n, least)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    label = rows.schema["label"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(vectors.matrix(batch.column(2).to_pylist(), size))
            _, own = index.lists(u)
            codes, error = index.encode(u, own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(error)], ["vec_id", "label", "v", "n", "list", "code", "error"]
            )

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, own = index.lists(unit(vectors.matrix(batch.column(2).to_pylist(), size)))
            row, of = index.probes(d, own, reach) if exact else index.nearest(d)
            for k in range(0, len(row), SENT):
                some = pa.array(row[k : k + SENT])
                yield pa.RecordBatch.from_arrays([*[c.take(some) for c in batch.columns], pa.array(of[k : k + SENT])], ["vec_id", "label", "v", "list"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = {x: batch.column(batch.schema.get_field_index(x)) for x in ("held", "probing", "list")}
            for i in range(batch.num_rows):
                held, seek = [(np.asarray(vectors.column(side[x], i, "vec_id")), vectors.matrix(vectors.column(side[x], i, "v").to_pylist(), size)) for x in ("held", "probing")]
                codes = np.frombuffer(b"".join(vectors.column(side["held"], i, "code").to_pylist()), np.uint8).reshape(len(held[0]), -1)
                error, weight = (np.asarray(vectors.column(side["held"], i, c)) for c in ("error", "n"))
                yield _links(index, side["list"][i].as_py(), *held, weight, codes, error, *seek, reach, least)

    members = rows.select("vec_id", "label", "v", "n").mapInArrow(coded, f"vec_id long, label {label}, v binary, n long, list long, code binary, error double")
    seekers = rows.select("vec_id", "label", "v").mapInArrow(probing, f"vec_id long, label {label}, v binary, list long")
    held = vectors.blocks(members, ["label", "list"], ["vec_id", "v", "n", "code", "error"], "held")
    seek = vectors.blocks(seekers, ["label", "list"], ["vec_id", "v"], "probing")
    met = held.join(seek, ["label", "list"]).select("list", "held", "probing")
    return store.keep(met.mapInArrow(linked, "a long, b long, n long"), "found")


def _sampled(rows: DataFrame, size: int) -> list:
    most = max(1, min(SAMPLE, vectors.SAMPLE_BYTES // (8 * size)))
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()


def unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)  # so that very large or small components don't overflow
    v = v / top
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def _links(index, of, ids, v, weight, codes, error, seeking, q, reach, least) -> pa.RecordBatch:
    """Rows ``(a, null, n)``: a seeker's links into the block, by weight; rows ``(a, b, 0)``: a spanning forest of them.

    ``weight`` says how many equal vectors each held one stands for."""
    u, x = unit(v), unit(q)
    about = sum(t[:, codes[:, k]] for k, t in enumerate(index.tables(x, of)))
    maybe = np.sqrt(about) <= reach + error[None, :] + 1e-6
    maybe &= seeking[:, None] != ids[None, :]
    row, col = np.nonzero(maybe)
    kept = [np.flatnonzero((x[row[k : k + PAIRS]] * u[col[k : k + PAIRS]]).sum(axis=1) >= least) + k for k in range(0, len(row), PAIRS)]
    kept = np.concatenate(kept) if kept else np.zeros(0, int)
    row, col = row[kept], col[kept]
    n = np.bincount(row, weight[col], minlength=len(seeking)).astype(np.int64)
    some = np.flatnonzero(n)
    a, b = _forest(seeking[row], ids[col])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([seeking[some], a]), pa.int64()), pa.array([None] * len(some) + b.tolist(), pa.int64()), pa.array(np.concatenate([n[some], np.zeros(len(a), int)]), pa.int64())],
        ["a", "b", "n"],
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the smallest of its component."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        smaller = np.minimum(low[i], low[j])
        np.minimum.at(low, i, smaller)
        np.minimum.at(low, j, smaller)
        low = low[low]
        if (low == before).all():
            apart = np.flatnonzero(low != np.arange(len(nodes)))
            return nodes[apart], nodes[low[apart]]
