"""Live counts of runs by route and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.streaming.run import new_folder, run_available, write_batches


def live_run_stats(runs: DataFrame, ts: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs, failures and total latency per window, route and status; later rows are dropped."""
    windowed = runs.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "route", "status")
    return windowed.agg(F.count("*").alias("runs"), F.sum("total_ms").alias("total_ms")).select(
        F.col("w.start").alias("window_start"), "route", "status", "runs", "total_ms")


ACCURACY = 1000  # a percentile's rank is off by at most one row in so many


def live_latency(runs: DataFrame, ts: str, every: str = "1 hour", late: str = "2 hours", share: float = 0.95) -> DataFrame:
    """Runs and a latency percentile (nearest rank) per window and route; later rows are dropped.

    The state of a window is a quantile sketch, which merges and stays bounded however many runs there are. Its rank
    is off by at most one row in ``ACCURACY``, and exact for windows of fewer rows."""
    windowed = runs.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "route")
    sketch = F.percentile_approx("total_ms", share, ACCURACY)
    return windowed.agg(F.count("*").alias("runs"), sketch.alias("latency")).select(F.col("w.start").alias("window_start"), "route", "runs", "latency")


def collect_live_latency(runs: DataFrame, ts: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Run the stream over the available input; the latest figures of every window are returned."""
    spark = runs.sparkSession
    folder = new_folder(spark, "latency")
    run_available(live_latency(runs, ts, every, late), write_batches(f"{folder}/rows"), folder, mode="update")
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("window_start", "route").agg(F.max_by("runs", "batch").alias("runs"), F.max_by("latency", "batch").alias("latency"))


def collect_live_stats(runs: DataFrame, ts: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Run the stream over the available input; the latest count of every window is returned."""
    spark = runs.sparkSession
    folder = new_folder(spark, "live")
    run_available(live_run_stats(runs, ts, every, late), write_batches(f"{folder}/rows"), folder, mode="update")
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("window_start", "route", "status").agg(
        F.max_by("runs", "batch").alias("runs"), F.max_by("total_ms", "batch").alias("total_ms"))
