"""Folders for intermediate tables: with and without ``spark.checkpoint.dir``."""

import os
import subprocess
import sys

import pytest

from quayside import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BARE = """
import sys; sys.path.insert(0, sys.argv[1])
from quayside.session import local_session, shared_dir
spark = local_session(1, memory="1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_dir(spark)
assert folder == shared_dir(spark.newSession())
spark.range(3).write.parquet(folder + "/x")
print(spark.read.parquet(folder + "/x").count())
"""


def test_a_session_without_a_folder_gets_one(tmp_path):
    """In a process of its own, with an empty Spark configuration."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", BARE, ROOT], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-1:] == ["3"], done.stderr[-2000:]


class _Session:
    def __init__(self, master, folder=None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})()


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_has_to_name_one(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(_Session(master))
    assert session.shared_dir(_Session(master, "hdfs:///shared")) == "hdfs:///shared"


AWAY = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master(sys.argv[2]).config("spark.ui.enabled", "false").getOrCreate()
from quayside.session import ship, tune
ship(tune(spark))

def run(batches):
    from quayside.functions.text import sql_list  # a worker has to find the package
    for batch in batches:
        yield batch

print(spark.range(3).mapInArrow(run, "id long").count())
"""


@pytest.mark.parametrize("master", ["local-cluster[1,1,1024]", "local[1]"])
def test_workers_get_the_package(tmp_path, master):
    """Workers started in another folder, with the package on the driver's path only."""
    done = subprocess.run([sys.executable, "-c", AWAY, ROOT, master], env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
                          cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert done.stdout.split()[-1:] == ["3"], done.stderr[-2000:]


def test_exchanges_begin_with_some_partitions_a_core(spark):
    """Few shuffle partitions don't bound how many there are; more than the library asks for stay."""
    raised = str(min(200, 8 * spark.sparkContext.defaultParallelism))
    names = [session.INITIAL_PARTITIONS, "spark.sql.shuffle.partitions"]
    before = {x: spark.conf.get(x, None) for x in names}
    try:
        for few, wanted in (("3", raised), ("777", "777")):
            spark.conf.unset(session.INITIAL_PARTITIONS)
            spark.conf.set("spark.sql.shuffle.partitions", few)
            session.tune(session.tune(spark))
            assert spark.conf.get(session.INITIAL_PARTITIONS) == wanted
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("kinds", ["a bigint, b int", "a bigint, b string", "a string, b string"])
def test_foreign_keys_are_counted_without_a_join(spark, kinds):
    """Null keys pass, keys that repeat count by row, parents may repeat, and no row of either is joined."""
    from quayside.operators import quality

    rows = [(7, 1), (7, 2), (7, None), (8, 2), (None, 5), (9, 9)]
    child = spark.createDataFrame([[x if t.endswith("int") or x is None else str(x) for x, t in zip(r, kinds.split(", "), strict=True)] for r in rows], kinds)
    parent = spark.createDataFrame([(7,), (7,), (2,), (None,), (100,)], "k bigint")
    refs = [quality.References("a", child, "a", parent, "k"), quality.References("b", child, "b", parent, "k"), quality.References("none", parent, "k", parent, "k")]
    found = quality.check_constraints(refs)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.select("constraint", "violations").collect()} == {("a", 2), ("b", 3), ("none", 0)}
