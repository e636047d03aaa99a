"""Statistics over the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.ranking import percentiles


def run_stats(runs: DataFrame) -> DataFrame:
    """Finished runs: total, success rate, mean and 95th percentile latency."""
    done = runs.filter("status <> 'running'")
    p95 = percentiles(done, "total_ms", {"p95": ("continuous", 0.95)}).select(F.round("p95", 1)).scalar()
    total = F.count("*")
    rate = F.when(total > 0, F.round(F.count_if(F.col("status") == "success") / total, 4)).otherwise(0.0)
    return done.agg(
        total.alias("total_runs"), rate.alias("success_rate"),
        F.round(F.coalesce(F.avg("total_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
    ).withColumn("p95_latency_ms", F.coalesce(p95, F.lit(0.0)))


def counts_with_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts per value (nulls left out) with the share of all and of the largest.

    The windows run over the aggregated vocabulary, not over the log."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("runs"))
    whole = Window.partitionBy(F.lit(1))
    return counts.select(
        column, "runs", F.round(F.col("runs") / F.sum("runs").over(whole), 6).alias("share"),
        F.round(F.col("runs") / F.max("runs").over(whole), 6).alias("relative"))


def recent_runs(runs: DataFrame, limit: int, user_id: int | None = None) -> DataFrame:
    """Newest runs, of one user unless the reader is an administrator."""
    mine = runs if user_id is None else runs.filter(F.col("user_id") == user_id)
    return mine.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def stage_timings(runs: DataFrame) -> DataFrame:
    """Per stage of the traces: runs, mean time, mean share of the run's longest stage.

    The longest stage is found inside the array, before the rows are exploded."""
    longest = F.greatest(F.lit(1), F.array_max(F.transform("trace", lambda s: s["duration_ms"])))
    stages = runs.select(longest.alias("longest"), F.explode("trace").alias("s"))
    return stages.groupBy(F.col("s.name").alias("stage")).agg(
        F.count("*").alias("runs"),
        F.round(F.avg("s.duration_ms"), 3).alias("avg_ms"),
        F.round(F.sum((F.col("s.duration_ms") * 1000000 / F.col("longest")).cast("bigint")) / F.count("*") / 1000000, 4)
        .alias("share_of_longest"),
        F.count_if(F.col("s.status") == "error").alias("errors"))


def token_totals(calls: DataFrame, run: str, prompt: Column, completion: Column) -> DataFrame:
    """Prompt, completion and total tokens per run; null where a run used none."""
    sums = calls.groupBy(run).agg(F.sum(prompt).alias("p"), F.sum(completion).alias("c"))
    used = F.col("p") + F.col("c") > 0
    return sums.select(run, F.when(used, F.col("p")).alias("prompt_tokens"),
                       F.when(used, F.col("c")).alias("completion_tokens"),
                       F.when(used, F.col("p") + F.col("c")).alias("total_tokens"))
