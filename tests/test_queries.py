"""Every registered query against its SQL at the smallest scale, and rules about plans."""

import os
import sys
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from check import kind, norm  # noqa: E402
from paths import SF  # noqa: E402
from quayside.plans import load_all  # noqa: E402
from quayside.sources.tables import SCHEMAS  # noqa: E402

QUERIES = dict(load_all())
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
PYTHON = ("s01", "t0", "t11", "t13", "r0", "r1", "e03", "a06", "st")  # file decoding, NFC, vector products, admission


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if not name.startswith("st"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        if not name.startswith(PYTHON):
            assert "EvalPython" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    types = {d[0]: kind(str(d[1])) for d in result.description}
    assert sorted(names) == columns
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields} == types
    assert rows == Counter(tuple(norm(row[names.index(c)]) for c in columns) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q01_orders_last_month"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_status_filters_reach_the_scan(spark):
    for name, pushed in (("q08_cancelled_this_year", "EqualTo(o_orderstatus,P)"), ("q02_revenue_last_30_days", "In(o_orderstatus, [F,O])")):
        assert pushed in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_one_scan_serves_all_checks_of_a_table(spark):
    plan = QUERIES["s11_constraint_violations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("Initial Plan")[0].splitlines() if "FileScan" in line]
    assert sum("/lineitem.parquet" in x for x in scans) <= 4  # unique key, foreign keys, checks, the inventory view
    features = QUERIES["t12_hash_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert features.count("FileScan") == 1 and "Aggregate" not in features  # counted in the row


def test_bucketed_snapshots_join_without_an_exchange(spark):
    from quayside.plans.quality import bucketed_snapshots
    from quayside.sources.tables import Tables

    orders, customers = bucketed_snapshots(Tables(spark, SF), 4)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = orders.join(customers, "custkey").groupBy("custkey").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
