"""The stored keyword index against a search that counts every matching position."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quayside.operators import keyword_index as ki
from quayside.operators import retrieval as r

ZIPF = [f"word{chr(97 + i % 26)}{i}" for i in range(400)]


def texts(n, seed=3):
    order = random.Random(seed)
    return [(i, " ".join(ZIPF[min(399, int(order.paretovariate(0.7)) - 1)] for _ in range(order.randrange(1, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = texts(3000) + [(5000, ""), (5001, None), (5002, "wordb1 " * 300), (5003, "wordb1 " * 300)]
    return spark.createDataFrame(rows, "chunk_id long, content string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    order = random.Random(8)
    rows = [(q, v, " ".join(order.choices(ZIPF[: 20 if q % 2 else 400], k=4))) for q in range(30) for v in (0, 1)]
    rows += [(90, 0, "nothing matches this"), (91, 0, "  "), (92, 0, None), (None, 3, "wordb1 wordc2")]
    return spark.createDataFrame(rows, "query_id long, variant int, text string")


def rows_of(found):
    return sorted(map(str, found.collect()))


@pytest.mark.parametrize(("shards", "span"), [(1, 128), (7, 128), (40, 8)])
def test_equals_counting_all_positions(spark, chunks, asked, shards, span):
    index = ki.build_index(chunks, "chunk_id", F.col("content"), shards, span=span)
    allowed = chunks.where("chunk_id % 3 <> 1").select("chunk_id")
    postings = r.build_postings(chunks, "chunk_id", F.col("content"))
    for only in (None, allowed):
        assert rows_of(ki.keyword_search(asked, index, 10, only)) == rows_of(r.keyword_search(asked, postings, 10, only))


def test_queries_in_blocks_and_terms_as_a_table(spark, chunks, asked, monkeypatch):
    index = ki.build_index(chunks, "chunk_id", F.col("content"), 5)
    want = rows_of(ki.search(asked, index, 6).drop("blocks", "read"))
    assert rows_of(ki.search(asked, index, 6, block=10).drop("blocks", "read")) == want
    monkeypatch.setattr(ki, "LISTED", 3)
    assert rows_of(ki.search(asked, index, 6).drop("blocks", "read")) == want


def test_ids_may_be_strings(spark):
    rows = [("b", "red boat"), ("a", "red boat"), ("c", "boat boat"), (None, "boat")]
    index = ki.build_index(spark.createDataFrame(rows, "chunk_id string, content string"), "chunk_id", F.col("content"), 2)
    asked = spark.createDataFrame([("q", 0, "red boat")], "query_id string, variant int, text string")
    assert [x["chunk_id"] for x in ki.keyword_search(asked, index, 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_nothing_to_search(spark, asked):
    index = ki.build_index(spark.createDataFrame([], "chunk_id long, content string"), "chunk_id", F.col("content"), 2)
    assert ki.keyword_search(asked, index).count() == 0
    index = ki.build_index(spark.createDataFrame([(1, "wordb1")], "chunk_id long, content string"), "chunk_id", F.col("content"), 2)
    assert ki.keyword_search(asked.where("query_id = 91"), index).count() == 0


def test_blocks_that_cannot_win_are_skipped(spark):
    """A few chunks in one part of the table say a frequent word very often."""
    rows = [(i, "common tide") for i in range(20_000)] + [(i, "tide " * 50) for i in range(20_000, 20_030)]
    index = ki.build_index(spark.createDataFrame(rows, "chunk_id long, content string"), "chunk_id", F.col("content"), 2)
    asked = spark.createDataFrame([(1, 0, "tide")], "query_id long, variant int, text string")
    found = ki.search(asked, index, 10).collect()
    assert [x["chunk_id"] for x in sorted(found, key=lambda x: x["rank"])] == list(range(20_000, 20_010))
    assert all(x["read"] <= x["blocks"] / 10 for x in found)


def test_a_search_reads_no_text_and_exchanges_only_results(spark, chunks, asked):
    index = ki.build_index(chunks, "chunk_id", F.col("content"), 7)
    plan = ki.search(asked, index)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan[^\n]*", plan)
    assert len(scans) == 2 and all("Bucketed: true" in s and "content" not in s for s in scans)
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "WindowGroupLimit" in plan  # k rows a query and task, by query


def test_runs_that_go_over_batches(spark, chunks, asked):
    """Blocks of many chunks a batch and of many batches a run are the same."""
    postings = r.build_postings(chunks, "chunk_id", F.col("content"))
    want = rows_of(r.keyword_search(asked, postings, 10))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        index = ki.build_index(chunks, "chunk_id", F.col("content"), 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows_of(ki.keyword_search(asked, index, 10)) == want
    assert spark.table(index.postings).groupBy("shard", "term", "run").count().where("count > 1").count() == 0


def test_shards_grow_with_the_texts(spark, chunks, monkeypatch):
    assert ki.build_index(chunks, "chunk_id", F.col("content"), least=2).shards == 2
    monkeypatch.setattr(ki, "SHARD_BYTES", 100_000)
    size = chunks.agg(F.sum(F.octet_length("content"))).first()[0]
    assert size > 200_000
    index = ki.build_index(chunks, "chunk_id", F.col("content"), least=2)
    assert index.shards == -(-size // 100_000)
    assert spark.table(index.directory).groupBy("shard").count().agg(F.max("count")).first()[0] < 3000 / index.shards * 2
