"""Vectors as binary rows (little-endian doubles), bounded samples of them, and bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 32 << 20
BLOCK = 1024


def usable(vector: str) -> F.Column:
    """Whether a vector is not null or zero and holds finite numbers only."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(df: DataFrame, vector: str, as_given: bool = False) -> DataFrame:
    """The vector column as ``v``, binary; the other columns stay.

    Components are doubles, or, if wanted ``as_given``, single-precision numbers where the column holds these."""
    rest = [c for c in df.columns if c != vector]
    kind = "<f4" if as_given and df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            values = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*rest, "v"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*[F.col(f"`{c}`") for c in [*rest, vector]]).mapInArrow(run, f"{kinds}, v binary")


def sample(df: DataFrame, most: int, size: int) -> np.ndarray:
    """At most ``most`` vectors, and ``SAMPLE_BYTES``, those with the lowest hash of their id."""
    most = max(1, min(most, SAMPLE_BYTES // (8 * size)))
    rows = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()
    return matrix([r["v"] for r in rows], size)


def matrix(values: list[bytes], size: int) -> np.ndarray:
    """Vectors as doubles; their bytes tell how they are kept."""
    whole = b"".join(values)
    kind = "<f4" if len(whole) == 4 * size * len(values) else "<f8"
    return np.frombuffer(whole, kind).astype(np.float64, copy=False).reshape(len(values), size)


def blocks(df: DataFrame, keys: list[str], fields: list[str], name: str, most: int = BLOCK) -> DataFrame:
    """Rows of a key together, about ``most`` in a block: ``keys, <name>`` (array of structs).

    A key with more rows than that has several blocks, dealt by a hash of the id."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    dealt = df.join(counts, keys).withColumn("_chunk", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("_n") / most).cast("long")))
    return dealt.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_chunk")


def column(lists: pa.Array, i: int, field: str) -> pa.Array:
    return lists.slice(i, 1).flatten().field(field)
