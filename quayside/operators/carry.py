"""Carry the last known value forward inside ordered groups of any size.

A plain window would put a whole group into one task. Here every group is cut into
blocks along its order column: one window works inside blocks, a second one over one
summary row per block, and the two are joined on (group, block)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.ranking import join_with_nulls

BLOCK = 4096


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Add the latest non-null ``value`` of the rows strictly before each row.

    ``order`` must be a number that is unique inside a group."""
    rows = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
    summary = rows.groupBy(*keys, "_block").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, "_block", F.last("_tail", ignorenulls=True).over(earlier).alias("_far"))
    return (
        join_with_nulls(rows, summary, [*keys, "_block"])
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_v", "_block", "_near", "_far")
    )
