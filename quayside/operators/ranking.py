"""Exact ranks and percentiles without putting all rows into one task.

Values are mapped by a monotone function to narrow buckets: a range between quantiles of the data, which a mergeable
sketch estimates, and inside it a logarithmic bucket. Ranges spread a narrow band of values wherever it lies, the
logarithm a heavy tail. The bucket histogram is small and bounded, so its running total may be taken in
one task; exact ordering then happens inside single buckets over *distinct* values with
counts, so a value that fills a third of the table is still one row."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 5000  # buckets per unit of ln(1 + |value|): about 0.02 % of the value


RANGES = 1024  # ranges of about equally many rows
LOG_BUCKETS = 2**24  # more than logarithmic buckets there are

NULLS, NANS = -(2**62), 2**62  # buckets of their own: nulls come last in falling order, NaN first


def bucket_of(value: Column, resolution: int = RESOLUTION) -> Column:
    """Order-preserving bucket; wide ranges and heavy tails still spread."""
    finite = F.floor(F.signum(value) * F.log1p(F.least(F.abs(value), F.lit(1.7e308))) * resolution)
    infinite = F.abs(value) == float("inf")
    beyond = F.when(value > 0, F.lit(NANS - 1)).otherwise(F.lit(NULLS + 1))
    return F.when(value.isNull(), F.lit(NULLS)).when(F.isnan(value), F.lit(NANS)).when(infinite, beyond).otherwise(finite)


def splitters(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Distinct finite values that cut the column into ranges of about equally many rows; estimated in one pass."""
    value = F.col(column).cast("double")
    finite = df.select(value.alias("v")).where(~F.isnan("v") & (F.abs("v") < float("inf")))
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(finite.agg(F.percentile_approx("v", shares, 4 * ranges)).first()[0] or []))


def bucketed(df: DataFrame, column: str, splits: list[float], resolution: int = RESOLUTION) -> DataFrame:
    """The rows with ``_b``, a bucket that rises with the column."""
    cuts = [float("-inf"), *(splits or [0.0]), float("inf")]
    ranged = Bucketizer(splits=cuts, inputCol="_x", outputCol="_range", handleInvalid="keep").transform(
        df.withColumn("_x", F.col(column).cast("double")))
    inner = bucket_of(F.col("_x"), resolution)
    special = F.col("_x").isNull() | F.isnan("_x") | (F.abs("_x") == float("inf"))
    return ranged.withColumn("_b", F.when(special, inner).otherwise(F.col("_range").cast("bigint") * LOG_BUCKETS + inner)).drop("_x", "_range")


def join_with_nulls(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on columns of the same names, where null equals null; the left columns stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def with_rank(df: DataFrame, column: str, name: str = "rank", by: list[str] | None = None,
              resolution: int = RESOLUTION) -> DataFrame:
    """RANK() OVER (PARTITION BY by ORDER BY column DESC), also for the whole table.

    NaN is the largest value and nulls come last; null keys are a group of their own."""
    keys = list(by or [])
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    counts = bucketed(counts, column, splitters(df, column), resolution)
    before = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")).select(
        *keys, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1
    ranks = join_with_nulls(counts, offsets, [*keys, "_b"]).select(*keys, column, rank.alias(name))
    return join_with_nulls(df, ranks, [*keys, column])


def percentiles(df: DataFrame, column: str, wanted: dict[str, tuple[str, float]],
                resolution: int = RESOLUTION) -> DataFrame:
    """One row of exact percentiles; kinds: "continuous" (interpolated) or "nearest" rank.

    First pass: bucket histogram. Second pass: only rows of the buckets that hold a
    wanted position are counted by value."""
    values = df.select(F.col(column).cast("double").alias("_v")).filter("_v is not null")
    values = bucketed(values, "_v", splitters(values, "_v"), resolution)
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    histogram = (
        values.groupBy("_b").agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(everything))
    )

    def positions(kind: str, p: float) -> tuple[Column, Column, Column]:
        total = F.col("_total")
        if kind == "nearest":
            at = F.greatest(F.lit(1), F.ceil(F.lit(p) * total))
            return at, at, F.lit(0.0)
        exact = F.lit(p) * (total - 1)
        return F.floor(exact) + 1, F.ceil(exact) + 1, exact - F.floor(exact)

    def covers(position: Column, first: Column, last: Column) -> Column:
        return (position > first) & (position <= last)

    hit = F.lit(False)
    for kind, p in wanted.values():
        low, high, _ = positions(kind, p)
        start = F.col("_upto") - F.col("_n")
        hit = hit | covers(low, start, F.col("_upto")) | covers(high, start, F.col("_upto"))
    targets = histogram.filter(hit).select("_b", (F.col("_upto") - F.col("_n")).alias("_start"), "_total")
    inside = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        values.join(targets, "_b").groupBy("_b", "_start", "_total", "_v").agg(F.count("*").alias("_n"))
        .withColumn("_last", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_first", F.col("_last") - F.col("_n"))
    )
    picked = []
    for name, (kind, p) in wanted.items():
        low, high, part = positions(kind, p)
        picked += [
            F.max(F.when(covers(low, F.col("_first"), F.col("_last")), F.col("_v"))).alias(f"{name}_low"),
            F.max(F.when(covers(high, F.col("_first"), F.col("_last")), F.col("_v"))).alias(f"{name}_high"),
            F.max(part).alias(f"{name}_part"),
        ]
    row = steps.agg(*picked)
    return row.select(*[
        (F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in wanted
    ])
