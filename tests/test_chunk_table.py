"""Replacement of documents in a chunk table as one change."""

import os

import pytest
from pyspark.sql import functions as F

from quayside.sources.chunk_table import ChunkTable

SCHEMA = "document_id bigint, chunk_index int, content string"


def chunks(spark, ids, word, n=2):
    return spark.createDataFrame([(i, k, f"{word} {i} {k}") for i in ids for k in range(n)], SCHEMA)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def test_only_the_touched_buckets_are_written(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path), SCHEMA, buckets=32)
    assert table.version() == 0 and table.read().count() == 0
    assert table.replace(chunks(spark, range(200), "old")) == 1
    before, first = files(tmp_path), set(table.read().inputFiles())
    assert table.replace(chunks(spark, [3, 4], "new", 3)) == 2
    assert before <= files(tmp_path)  # nothing is written over
    now = set(table.read().inputFiles())
    assert len(now & first) >= len(first) * 29 // 32 and len(first - now) <= 8
    rows = {(r["document_id"], r["chunk_index"]): r["content"] for r in table.read().collect()}
    assert len(rows) == 198 * 2 + 2 * 3 and rows[3, 2] == "new 3 2" and rows[5, 1] == "old 5 1"
    assert table.read(1).where("content like 'new%'").count() == 0  # the version before is still there


def test_documents_may_lose_all_chunks_or_be_new(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path), SCHEMA, buckets=4)
    table.replace(chunks(spark, [1, 2], "a"))
    table.replace(chunks(spark, [9], "b"), spark.createDataFrame([(1,)], "document_id bigint"))
    assert {r["document_id"] for r in table.read().collect()} == {2, 9}
    table.replace(chunks(spark, [], "c"), spark.createDataFrame([(2,), (9,)], "document_id bigint"))
    assert table.read().count() == 0 and table.version() == 3


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path), SCHEMA, buckets=4)
    table.replace(chunks(spark, range(20), "a"))
    broken = chunks(spark, range(10), "b").withColumn("content", F.when(F.col("document_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert table.version() == 1 and table.read().where("content like 'b%'").count() == 0
    os.makedirs(tmp_path / "versions" / "version=2")  # a list that was begun only
    assert table.version() == 1
    assert table.replace(chunks(spark, [7], "c")) == 2
    assert table.read().where("document_id = 7").count() == 2
