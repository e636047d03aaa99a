"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or physical strategy and may be set at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 * 1024 * 1024),
    # Joins are never hinted: a side is broadcast only when its measured or estimated
    # size is below this bound, otherwise Spark shuffles and AQE splits hot keys.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # State of streams on local disk, backed up with the checkpoint, instead of in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Exchanges begin with so many partitions a core at least, which AQE puts together up to 16 MB, so that what a task
# aggregates or sorts doesn't follow the rows over a small ``spark.sql.shuffle.partitions``. Up to 200 partitions a task
# writes without sorting.
PER_CORE, MOST_RAISED = 8, 200
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Joins measure a side by its files or by what was shuffled, both compressed: a broadcast table takes up to 25 times as much on the
# driver's heap (names and brands of products). Whoever runs whole-table joins from the driver bounds them by this.
SMALL_BROADCAST = 2 * 1024 * 1024

LOCAL = r"local(\[.*\])?"  # masters without executors of their own

_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created, and send the package to its workers."""
    ship(spark)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    set_to = spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(INITIAL_PARTITIONS, str(max(int(set_to), min(MOST_RAISED, PER_CORE * spark.sparkContext.defaultParallelism))))
    return spark


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside broadcast no side of a join above ``SMALL_BROADCAST``: the driver holds little, whatever the tables' size."""
    before = {key: spark.conf.get(key, None) for key in _BROADCASTS}
    for key in _BROADCASTS:
        spark.conf.set(key, str(SMALL_BROADCAST))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def local_session(cpus: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cores = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quayside")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_own_folders: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) is a local folder made, one for each application."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not re.fullmatch(LOCAL, context.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="quayside-")
    return _own_folders[context.applicationId]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path whose write was completed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(base):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(base) if files.exists(hadoop.Path(f.getPath(), "_SUCCESS")))


FEW_SPLITS = 64


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work on a handful of small files one partition per core.

    A scan of more than ``FEW_SPLITS`` partitions is left alone however many cores there are, so that the texts of
    large tables never move. For plain scans only: planning a join to count its partitions would run it."""
    cores = min(FEW_SPLITS, scan.sparkSession.sparkContext.defaultParallelism)
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


_shipped: set[str] = set()  # by application


def ship(spark: SparkSession) -> None:
    """Send this package, once an application, to the workers, which may not have it installed or on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quayside-"), "quayside"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
