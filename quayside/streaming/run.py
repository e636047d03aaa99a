"""Run a streaming query over what is there now, into a table in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Process all available input batch by batch; ``write`` must be repeatable per batch id."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink with one folder per batch: a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
