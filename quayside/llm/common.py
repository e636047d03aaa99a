"""Helpers that several operators share: words, stored tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import shared_dir, ship


BATCH_ROWS = 2048  # whole texts in an Arrow batch: some MB, twice in a task's memory


class Store:
    """A new folder for intermediate tables below the shared folder of the session, whose Arrow batches are kept small."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if int(spark.conf.get(size, "0")) not in range(1, BATCH_ROWS + 1):
            spark.conf.set(size, BATCH_ROWS)
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.kept = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: later steps don't depend on the executors that made it."""
        self.kept += 1
        path = f"{self.base}/{self.kept}-{name}"
        df.write.parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fold(column: str, remainder_of: int) -> F.Column:
    """crc32 of an id as text, modulo ``remainder_of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % remainder_of


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` cells of some 64-bit hashes; of bounded size, whatever the rows.

    It spares work on what isn't there; a cell may hold others, so a join has to follow."""
    h = (F.shiftrightunsigned(column, 64 - bits) + 1).alias("h")
    held = rows.select(h).groupBy(F.bitmap_bucket_number("h").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    cells = np.zeros(1 << (bits - 3), np.uint8)
    for row in held.repartition(4).toLocalIterator():  # 4 kB a row; a job for each partition
        cells[(row["at"] - 1) * 4096 : row["at"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return cells


def in_bitmap(cells: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    cell = h.view(np.uint64) >> np.uint64(64 - bits)
    return (cells[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class Forest:
    """Disjoint sets over any hashable values; the smallest value of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        path = []
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    def join(self, a, b) -> bool:
        """Unite two sets; whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def thin(batches: Iterator[pa.RecordBatch], limit: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same vertices as those read; at most ``limit`` are held at a time."""
    forest, kept = Forest(), []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if forest.join(a, b):
                kept.append((a, b))
                if len(kept) == limit:
                    yield to_batch(kept, schema)
                    forest, kept = Forest(), []
    yield to_batch(kept, schema)


def components(edges: DataFrame, store: Store, rounds: int = 40) -> DataFrame:
    """``(node, component)`` of every vertex of ``edges(a, b)``; component is the smallest vertex.

    Alternates large-star and small-star steps. Each step is an aggregation with partial minima and
    a join that the engine may split, so a vertex with very many edges is no single group."""
    pair = (
        edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .where("a is not null and b is not null and a <> b")
        .mapInArrow(thin, "a long, b long")
    )
    pair = store.keep(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0")
    before = None
    for step in range(1, rounds + 1):
        both = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pair = store.keep(small, f"edges-{step}")
        state = tuple(pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if state == before and state[0] == state[2]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
