"""Operator 6: n-gram Jaccard join with token-combination prefixes.

A document is the set of its word n-grams. All sets follow one order of n-grams, rare ones first, by a
count of all n-grams of all documents in a fixed number of cells. If two sets are similar enough,
the prefixes of both share an n-gram. Frequent n-grams would put unrelated documents together, so they count only
in pairs: the prefix is extended until its rare n-grams, and the frequent ones less one in each of
``GROUPS`` classes, exceed the number of n-grams that a similar set may lack; then the sets share
a rare n-gram or a pair of frequent ones of one class. Very small and very large sets use single n-grams
throughout; sets near the limits do both, so no pair falls between.

Equal sets are one. Sets of similar size that share a signature are compared by how many n-grams they hold in
each of a few dozen parts of the hash space, which bounds what they can have in common; those that
pass form clusters. Only clusters are verified, exactly, in bounded blocks. Large clusters are verified block by block against one leading block
first, and then only across the components that this leaves. So the links of a group of copies are never listed:
blocks give spanning forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from quayside.llm.common import Store, bitmap, components, in_bitmap, thin, words

CELL_BITS, SLICE_BITS = 22, 16  # cells of the count, and cells that one row of it holds
GROUPS = 8
PAIRED = (64, 2048)  # sizes of sets whose frequent n-grams count in pairs
BLOCK_SETS, BLOCK_GRAMS = 256, 1 << 20
PARTS = 64  # parts of the hash space whose n-grams are counted
SMALL_BUCKET = 256  # sets of a signature that are compared with each other; more are one cluster unseen
PAIRS = 1 << 17
SIGNATURE_BITS, ID_BITS = 26, 23  # of bitmaps that spare work
COLUMNS = 8192


def ngrams(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of fewer words, the whole sequence as one."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < width:
        return np.array([xxh3_64_intdigest(b" ".join(found))], np.uint64)
    h = np.array(list(map(xxh3_64_intdigest, found)), np.uint64)
    total = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        total += h[k : len(h) - width + 1 + k]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def lacking(n: int, percent: int) -> int:
    """How many members of a set of ``n`` a similar set may lack at most."""
    return n - (percent * n + 99) // 100


def signatures(grams: np.ndarray, levels: np.ndarray, cut: int, percent: int) -> np.ndarray:
    """Signed 64-bit signatures of a set; ``levels`` order the n-grams by cell, those above ``cut`` are frequent."""
    n = len(grams)
    need = lacking(n, percent) + 1
    level = levels[grams >> np.uint64(64 - CELL_BITS)]
    order = np.lexsort((grams, level))
    ordered, often = grams[order], level[order] > cut
    found = []
    if n * percent < PAIRED[0] * 100 or n * 100 >= PAIRED[1] * percent:
        found.append(_mixed(ordered[:need], 1))
    if PAIRED[0] <= n < PAIRED[1]:
        rare = int(n - often.sum())
        found.append(_mixed(ordered[: min(need, rare)], 2))
        if rare < need:
            rest = ordered[rare:]
            group = rest % np.uint64(GROUPS)
            gain = np.ones(len(rest), int)
            gain[np.unique(group, return_index=True)[1]] = 0
            end = int(np.searchsorted(np.cumsum(gain), need - rare)) + 1
            for g in range(GROUPS):
                members = rest[:end][group[:end] == g]
                a, b = np.triu_indices(len(members), 1)
                low, high = np.minimum(members[a], members[b]), np.maximum(members[a], members[b])
                found.append(_mixed(low * np.uint64(0xA24BAED4963EE407) + high, 3))
    return np.unique(np.concatenate(found)).view(np.int64)


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ np.uint64(kind)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _measure(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (id, size, fingerprint), and the task's counts of n-grams by cell in slices."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("counts", pa.binary()), ("slice", pa.int32()), ("cells", pa.binary()), ("times", pa.binary())])
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    for batch in batches:
        sizes, prints, spread, cells = [], [], [], []
        for text in batch.column(1).to_pylist():
            grams = ngrams(text, width)
            sizes.append(len(grams))
            prints.append(xxh3_128_digest(grams.tobytes()))
            spread.append(counts_of(grams))
            cells.append((grams >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
            if sum(map(len, cells[-64:])) > 1 << 20 or len(cells) >= 512:
                _add(counts, cells)
        _add(counts, cells)
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(spread, pa.binary()), *[pa.nulls(k, f.type) for f in list(schema)[4:]]], schema=schema)
    for at in range(0, 1 << CELL_BITS, 1 << SLICE_BITS):
        part = counts[at : at + (1 << SLICE_BITS)]
        if len(used := np.flatnonzero(part)):
            if 6 * len(used) < len(part) or part.max() > 255:
                listed = used.astype("<u2").tobytes(), part[used].astype("<u4").tobytes()
            else:
                listed = b"", part.astype("u1").tobytes()  # all cells, a byte each
            row = [None, None, None, None, at >> SLICE_BITS, *listed]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def counts_of(grams: np.ndarray) -> bytes:
    """How many n-grams lie in each part of the hash space; 255 for all stands for no count, if one is larger."""
    counts = np.bincount((grams % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
    return (counts if counts.max(initial=0) < 255 else np.full(PARTS, 255)).astype(np.uint8).tobytes()


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Buckets of sets in rows: a spanning forest of the pairs that may be similar."""
    for batch in batches:
        bucket = batch.column(0)
        flat, sizes = bucket.flatten(), np.asarray(bucket.value_lengths())
        ids, n = np.asarray(flat.field("doc_id")), np.asarray(flat.field("n"))
        counts = np.frombuffer(b"".join(flat.field("counts").to_pylist()), np.uint8).reshape(len(ids), PARTS)
        uncounted = (counts == 255).all(axis=1)
        starts = np.cumsum(sizes) - sizes
        left, right = [], []
        for m in np.unique(sizes):
            i, j = np.triu_indices(m, 1)
            of = starts[sizes == m][:, None]
            i, j = (of + i).ravel(), (of + j).ravel()
            for k in range(0, len(i), PAIRS):
                a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                smaller = np.minimum(n[a], n[b])
                common = np.where(uncounted[a] | uncounted[b], smaller, np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64))
                may = 100 * common >= percent * (n[a] + n[b] - common)
                left.append(ids[a[may]])
                right.append(ids[b[may]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = forest(nodes, at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _add(counts: np.ndarray, cells: list[np.ndarray]) -> None:
    if cells:
        used, n = np.unique(np.concatenate(cells), return_counts=True)
        counts[used] += n.astype(np.uint32)
        cells.clear()


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, cells, times in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            held = total.setdefault(at, np.zeros(1 << SLICE_BITS, np.uint64))
            if cells:
                held[np.frombuffer(cells, "<u2")] += np.frombuffer(times, "<u4")
            else:
                held += np.frombuffer(times, "u1")
    for at, held in total.items():
        level = np.round(256 * np.log2(1 + held.astype(float))).astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level], pa.binary()), pa.array([int(held.sum())], pa.int64())], ["slice", "level", "n"])


def _levels(measured: DataFrame) -> tuple[np.ndarray, int]:
    """The level of each cell (bounded: ``2 ** CELL_BITS`` small numbers), and above which one is frequent."""
    slices = 1 << (CELL_BITS - SLICE_BITS)
    dealt = measured.where("slice is not null").select("slice", "cells", "times").repartition(slices, "slice")
    levels, total = np.zeros(1 << CELL_BITS, "<u2"), 0
    for row in dealt.mapInArrow(_sum_cells, "slice int, level binary, n long").collect():
        levels[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = np.frombuffer(row["level"], "<u2")
        total += row["n"]
    mean = total / (1 << CELL_BITS)
    return levels, int(256 * np.log2(1 + mean + 6 * np.sqrt(mean) + 32))


def overlap_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the exact links among some sets: edges to the smallest id of each component."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[at] > 1
    owner, at = owner[shared], at[shared]
    number = np.cumsum(n > 1) - 1
    at = number[at]
    common = np.zeros((len(sets), len(sets)), np.float32)  # counts up to 2 ** 24 are exact
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(at[-1]) + 1 - low)), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    return forest(ids, *np.nonzero(np.triu(linked, 1)))


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked id to the smallest of its component."""
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    i, j = place[i], place[j]
    low = np.arange(len(ids))
    while True:
        before = low.copy()
        smaller = np.minimum(low[i], low[j])
        np.minimum.at(low, i, smaller)
        np.minimum.at(low, j, smaller)
        low = low[low]
        if (low == before).all():
            apart = np.flatnonzero(low != np.arange(len(low)))
            return ids[order[apart]], ids[order[low[apart]]]


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges among the sets of one or two blocks in a row."""
    for batch in batches:
        for i in range(batch.num_rows):
            held: dict[int, list[np.ndarray]] = {}
            for column in batch.columns:
                part = column.slice(i, 1).flatten()
                if len(part):
                    for doc, grams in zip(part.field("doc_id").to_pylist(), part.field("grams").to_pylist(), strict=True):
                        held.setdefault(doc, []).append(np.frombuffer(grams, "<u8"))
            ids = np.array([d for d, x in held.items() for _ in x], np.int64)
            a, b = overlap_links(ids, [y for x in held.values() for y in x], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _blocks(rows: DataFrame, key: list[str], chunk: F.Column) -> DataFrame:
    return rows.groupBy(*key, chunk.alias("chunk")).agg(F.collect_list(F.struct("doc_id", "grams")).alias("block"))


def jaccard_components(docs: DataFrame, store: Store, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets; ``component_id``
    is the smallest id reachable. Null, empty and blank texts have no n-gram and link with nothing. Rows
    that repeat an id are one document that has the links of all its texts; each row is returned.
    Rows without an id are returned with a null component and link with nothing. Other columns are
    dropped. N-grams and equal sets are told apart by 64 and 128-bit hashes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = "doc_id long, n long, fp binary, counts binary, slice int, cells binary, times binary"
    measured = store.keep(texts.mapInArrow(lambda b: _measure(b, width), names), "measured")
    rows = measured.where("n is not null").select("doc_id", "n", "fp", "counts")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("counts").alias("counts"))
    classes = store.keep(classes, "classes")

    least = percent / (100 - percent)  # smaller sets have only equal ones as partners
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_levels(measured))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, cut = shared.value
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(text, width)
                if len(grams) >= least:
                    ids.append(doc)
                    found.append(signatures(grams, levels, cut, percent))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "signatures"])

    reps = classes.where(F.col("n") >= least).select(F.col("rep").alias("doc_id")).distinct()
    signed_rows = texts.where("doc_id is not null").mapInArrow(signed, "doc_id long, signatures array<long>")
    signed_rows = store.keep(signed_rows.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("signatures").alias("s")), "signatures")
    repeated = signed_rows.groupBy("s").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    cells = spark.sparkContext.broadcast(bitmap(repeated, "s", SIGNATURE_BITS))

    def repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(cells.value, batch.column(1).to_numpy(zero_copy_only=False), SIGNATURE_BITS)))

    # Similar sets have similar sizes, so those of a signature meet by size: the sizes of two neighbouring
    # bands together. A band is as wide as sizes of similar sets may differ.
    size_of = classes.select(F.col("rep").alias("doc_id"), "n").distinct()
    band = F.floor(F.log(F.col("n").cast("double")) / (np.log(100 / percent) * 1.0001))
    in_bands = signed_rows.mapInArrow(repeating, "doc_id long, s long").join(size_of, "doc_id")
    in_bands = in_bands.select("doc_id", "s", F.explode(F.array(band, band + 1)).alias("band"))
    leads = in_bands.groupBy("s", "band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count("*").alias("m")).where("lead < last").drop("last")
    found = store.keep(in_bands.join(leads, ["s", "band"]), "candidates")
    in_large = found.where((F.col("m") > SMALL_BUCKET) & (F.col("doc_id") != F.col("lead"))).select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    counts = classes.select(F.col("rep").alias("doc_id"), "n", "counts")
    small = found.where(F.col("m") <= SMALL_BUCKET).join(counts, "doc_id").groupBy("s", "band").agg(F.collect_list(F.struct("doc_id", "n", "counts")).alias("bucket"))
    stars = in_large.union(small.select("bucket").mapInArrow(lambda b: thin(_compare(b, percent)), "a long, b long")).distinct()
    clusters = components(stars, store).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster")
    clusters = store.keep(clusters.join(classes.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n").alias("size")), "doc_id"), "clusters")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_GRAMS), F.lit(1)).cast("long")
    placed = clusters.join(clusters.groupBy("cluster").agg(parts.alias("chunks")), "cluster")
    placed = placed.select("doc_id", "cluster", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("chunk"))

    # Sets of the clustered documents only: a bitmap of bounded size spares the others the work.
    wanted = spark.sparkContext.broadcast(bitmap(clusters.select(F.xxhash64("doc_id").alias("h")), "h", ID_BITS))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy(zero_copy_only=False), ID_BITS)))
            found = [(doc, ngrams(text, width)) for doc, text in zip(taken.column(0).to_pylist(), taken.column(1).to_pylist(), strict=True)]
            found = [(doc, x.tobytes()) for doc, x in found if len(x) >= least]
            columns = zip(*found, strict=True) if found else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary()), strict=True)], ["doc_id", "grams"])

    sets = texts.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(members, "doc_id long, grams binary")
    blocks = store.keep(_blocks(sets.join(placed, "doc_id"), ["cluster", "chunks"], F.col("chunk")), "blocks")
    nothing = F.lit(None).cast(blocks.schema["block"].dataType).alias("leading")
    alone = blocks.where("chunks = 1 or chunk = 0").select("block", nothing)
    several = blocks.where("chunks > 1")
    led = several.where("chunk > 0").join(several.where("chunk = 0").select("cluster", F.col("block").alias("leading")), "cluster", "left").select("block", "leading")
    edges = store.keep(alone.union(led).mapInArrow(lambda b: _verify(b, percent), "a long, b long"), "links")

    # Clusters of several blocks that are still apart: whatever belongs to different components.
    if several.limit(1).count():
        joined = components(edges, store).withColumnRenamed("node", "doc_id")
        apart = several.select("cluster", F.inline("block")).withColumn("size", F.octet_length("grams") / 8)
        apart = store.keep(apart.join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "apart")
        size = apart.groupBy("cluster", "component").agg(F.count("*").alias("many"), F.sum("size").alias("grams_in"))
        small = F.col("many") < BLOCK_SETS
        open_ = size.groupBy("cluster").agg(F.count("*").alias("parts"), F.sum(F.when(small, F.col("many"))).alias("few"), F.sum(F.when(small, F.col("grams_in"))).alias("few_grams")).where("parts > 1")
        together = apart.join(size, ["cluster", "component"]).join(open_.drop("parts"), "cluster")
        parts = F.greatest(F.ceil(F.when(small, F.greatest(F.col("few") / BLOCK_SETS, F.col("few_grams") / BLOCK_GRAMS)).otherwise(F.greatest(F.col("many") / BLOCK_SETS, F.col("grams_in") / BLOCK_GRAMS))), F.lit(1)).cast("long")
        together = together.withColumn("whole", F.when(small, F.lit(None)).otherwise(F.col("component")))
        dealt = F.pmod(F.xxhash64(F.when(small, F.col("component")).otherwise(F.col("doc_id"))), parts)
        mixed = store.keep(_blocks(together, ["cluster", "whole"], dealt), "mixed")
        left, right = mixed.alias("l"), mixed.alias("r")
        both_mixed = F.col("l.whole").isNull() & F.col("r.whole").isNull()
        before = (F.coalesce("l.whole", F.lit(-1)) < F.coalesce("r.whole", F.lit(-1))) | (both_mixed & (F.col("l.chunk") <= F.col("r.chunk")))
        others = left.join(right, (F.col("l.cluster") == F.col("r.cluster")) & before)
        same = both_mixed & (F.col("l.chunk") == F.col("r.chunk"))
        others = others.select(F.col("l.block").alias("block"), F.when(~same, F.col("r.block")).alias("leading"))
        edges = edges.union(store.keep(others.mapInArrow(lambda b: _verify(b, percent), "a long, b long"), "more"))

    # An id with several texts joins their sets.
    of_rows = rows.where("n > 0 and doc_id is not null").join(classes.select("fp", "rep"), "fp")
    several_texts = of_rows.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc_id")
    own = of_rows.join(several_texts, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(edges.union(own), store)
    result = rows.join(classes.select("fp", "rep"), "fp", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
