import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.streaming import admission
from quayside.streaming.admission import admit, admit_stream
from quayside.streaming.indexing import DocumentIndex
from quayside.streaming.live import collect_live_latency, collect_live_stats
from quayside.streaming.run import run_available, write_batches

START = datetime.datetime(2024, 1, 1)


def naive(hits, limit, window):
    """Judge every hit against the list of all hits accepted so far."""
    accepted, out = {}, {}
    for hit, key, second in sorted(hits, key=lambda h: (h[1], h[2], h[0])):
        live = [a for a in accepted.get(key, []) if a > second - window]
        ok = len(live) < limit
        out[hit] = (ok, None if ok else max(1, int(np.ceil(live[0] + window - second))))
        if ok:
            accepted.setdefault(key, []).append(second)
    return out


def frame(spark, hits):
    return spark.createDataFrame([(h, k, START + datetime.timedelta(seconds=s)) for h, k, s in hits], "hit bigint, key string, ts timestamp")


def outcome(df):
    return {r["hit"]: (r["accepted"], r["retry_after"]) for r in df.collect()}


def test_limit_and_independent_keys(spark):
    hits = [(1, "k", 0), (2, "k", 0), (3, "k", 0), (4, "k", 0), (5, "other", 0), (6, "k", 61), (7, "k", 121)]
    got = outcome(admit(frame(spark, hits), "key", "ts", "hit", 3, 60))
    assert got[4] == (False, 60) and got[5][0] and got[6][0] and got == naive(hits, 3, 60)


def test_hit_at_the_edge_expires(spark):
    hits = [(1, "k", 0), (2, "k", 60)]
    assert outcome(admit(frame(spark, hits), "key", "ts", "hit", 1, 60))[2] == (True, None)


def test_hot_key_equals_naive(spark):
    rng = np.random.default_rng(5)
    hits = [(i, "hot" if rng.random() < 0.4 else f"k{rng.integers(20)}", int(rng.integers(4000))) for i in range(3000)]
    assert outcome(admit(frame(spark, hits), "key", "ts", "hit", 3, 60)) == naive(hits, 3, 60)


def drops(spark, df, order, folder, n=3):
    """Write a table as n files in time order."""
    ordered = df.orderBy(order).toPandas()
    for i, part in enumerate(np.array_split(ordered.index, n)):
        spark.createDataFrame(ordered.loc[part], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:02d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_admission_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    hits = frame(spark, [(i, f"k{rng.integers(5)}", i * 7) for i in range(300)])
    stream = drops(spark, hits, "ts", tmp_path / "in")
    run_available(admit_stream(stream, "key", "ts", "hit", 3, 60, evict_idle=False), write_batches(f"{tmp_path}/out/rows"), f"{tmp_path}/out")
    assert outcome(spark.read.parquet(f"{tmp_path}/out/rows")) == outcome(admit(hits, "key", "ts", "hit", 3, 60))


def steady(n, seed=4):
    """One key that never pauses for a window."""
    rng = np.random.default_rng(seed)
    return [(i, "busy", int(s)) for i, s in enumerate(np.cumsum(rng.integers(1, 25, n)))]


@pytest.mark.parametrize(("limit", "hits"), [
    (3, steady(2000)), (8, steady(1500)), (1, [(i, "busy", 20 * i) for i in range(700)]),
    (2, steady(600) + [(10_000 + i, f"k{i % 7}", 13 * i) for i in range(300)] + [(20_000 + i, "busy", 50) for i in range(90)]),
])
def test_a_key_that_never_pauses_runs_in_blocks(spark, limit, hits):
    df = frame(spark, hits).repartition(4)
    assert outcome(admit(df, "key", "ts", "hit", limit, 60, block_hits=100)) == naive(hits, limit, 60)


def test_blocks_are_several_tasks(spark):
    df = frame(spark, steady(4000)).withColumn("at", F.unix_micros("ts")).select("key", F.lit(0).cast("bigint").alias("stretch"), "at", "hit")
    rows, starts = admission._in_blocks(df, 3, 60_000_000, 200)
    assert rows.select("block").distinct().count() >= 18 and starts.count() > 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share a task
    try:
        assert admission._ordered(rows, starts).withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blocks_that_never_agree_go_through_one_task(spark):
    """A hit a second, one a minute admitted: a block's own start never meets the true one."""
    hits = [(i, "busy", i) for i in range(3000)]
    assert outcome(admit(frame(spark, hits), "key", "ts", "hit", 1, 61, block_hits=200)) == naive(hits, 1, 61)


def test_idle_keys_leave_by_the_watermark(spark, tmp_path):
    """Five micro-batches; the state holds the keys of the last window only, and at the end those within the allowed lateness."""
    rows = [(i, f"k{i // 40}", i * 30) for i in range(400)]
    hits = frame(spark, rows)
    stream = drops(spark, hits, "ts", tmp_path / "in", 5)
    admitted = admit_stream(stream, "key", "ts", "hit", 3, 60, late="1 minute")
    run_available(admitted, write_batches(f"{tmp_path}/out/rows"), f"{tmp_path}/out")
    assert outcome(spark.read.parquet(f"{tmp_path}/out/rows")) == naive(rows, 3, 60)
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/out/_progress")
    assert {r["key"]["key"] for r in state.collect()} == {"k9"}
    assert state.count() <= 3


def test_live_stats_equal_batch(spark, tables, tmp_path):
    runs = tables.commerce.agent_runs().select(
        F.col("created_at").cast("timestamp").alias("created_at"), F.coalesce("route", F.lit("none")).alias("route"), "status", "total_ms")
    got = collect_live_stats(drops(spark, runs, "created_at", tmp_path / "in"), "created_at").select("window_start", "route", "status", "runs", "total_ms")
    want = runs.groupBy(F.date_trunc("hour", "created_at").alias("window_start"), "route", "status").agg(
        F.count("*").alias("runs"), F.sum("total_ms").alias("total_ms"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_live_latency_is_within_the_sketch_error(spark, tmp_path):
    """More rows than the sketch holds exactly, over four micro-batches, and a row that comes too late."""
    rng = np.random.default_rng(8)
    day = datetime.datetime(2024, 5, 1)
    values = [int(x) for x in rng.lognormal(6, 1.5, 40_000)]
    rows = [(day + datetime.timedelta(seconds=i // 4), "a" if i % 3 else "b", v) for i, v in enumerate(values)]
    late = [(day - datetime.timedelta(days=3), "a", 1)]
    df = spark.createDataFrame(rows, "at timestamp, route string, total_ms bigint")
    stream = drops(spark, df, "at", tmp_path / "in", 3)
    spark.createDataFrame(late, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    got = {(r["window_start"], r["route"]): (r["runs"], r["latency"]) for r in collect_live_latency(stream, "at", every="1 day").collect()}
    assert {k[0] for k in got} == {day}
    for route in "ab":
        mine = np.sort([v for _, r, v in rows if r == route])
        runs, latency = got[day, route]
        low, high = np.searchsorted(mine, latency, "left"), np.searchsorted(mine, latency, "right")
        assert runs == len(mine) and low - len(mine) / 1000 - 1 <= 0.95 * len(mine) <= high + len(mine) / 1000 + 1


def test_index_over_three_drops(spark, tables, tmp_path):
    docs = tables.documents.select(F.col("doc_id").alias("document_id"), "text", F.lit(False).alias("reindex")).cache()
    one = DocumentIndex(spark, f"{tmp_path}/one")
    one.process(docs, 0)
    three = DocumentIndex(spark, f"{tmp_path}/three")
    for i in range(3):
        part = docs.filter(F.floor(F.col("document_id") * 3 / 200) == i)
        three.process(part, i)
        if i == 1:
            three.process(part, i)  # a repeated batch changes nothing
    key = lambda rows: sorted((r["document_id"], r["status"], r["chunk_count"]) for r in rows)
    assert key(three.attempts().collect()) == key(one.attempts().collect())
    assert three.chunks().count() == one.chunks().count()


def test_reindex_replaces(spark, tmp_path):
    index = DocumentIndex(spark, f"{tmp_path}/i")
    schema = "document_id bigint, text string, reindex boolean"
    index.process(spark.createDataFrame([(1, "Old text.", False), (2, " ", False), (3, "Old text.", False)], schema), 0)
    status = {r["document_id"]: r["status"] for r in index.attempts().collect()}
    assert status == {1: "indexed", 2: "failed", 3: "refused"}
    index.process(spark.createDataFrame([(1, "New text.", True), (4, "Old text.", False)], schema), 1)
    assert [r["content"] for r in index.chunks().filter("document_id = 1").collect()] == ["New text."]
    assert {r["document_id"]: r["status"] for r in index.attempts().filter("batch = 1").collect()} == {1: "indexed", 4: "refused"}


def test_last_version_of_a_batch_with_repeats_nulls_and_flags(spark, tmp_path):
    schema = "document_id bigint, text string, reindex boolean, sent int"
    index = DocumentIndex(spark, str(tmp_path / "versions"))
    index.process(spark.createDataFrame([(2, "kept text", False, 1)], schema), 0)
    rows = [(1, "text A", False, 1), (1, "text B", False, 2), (1, "text A", False, 3), (2, "kept text", False, 1), (2, "kept text", True, 1),
            (3, None, False, 2), (3, "older", False, 1), (None, "nobody's", False, 1)]
    index.process(spark.createDataFrame(rows, schema).repartition(3), 1)
    got = {(r["document_id"], r["status"], r["chunk_count"]) for r in index.attempts().filter("batch = 1").collect()}
    assert got == {(1, "indexed", 1), (1, "superseded", 0), (2, "indexed", 1), (3, "failed", 0), (3, "superseded", 0), (None, "failed", 0)}
    assert {(r["document_id"], r["content"]) for r in index.chunks().collect()} == {(1, "text A"), (2, "kept text")}


def test_texts_are_not_exchanged_and_nothing_staged_stays(spark, tmp_path, monkeypatch):
    """Plans of a second batch: exchanges carry ids and checksums only."""
    schema = "document_id bigint, text string, reindex boolean, sent int"
    index = DocumentIndex(spark, str(tmp_path / "plans"))
    index.process(spark.createDataFrame([(i, f"text {i}", False, 1) for i in range(50)], schema), 0)
    plans = []
    keep = DocumentIndex._staged

    def watched(self, rows, path):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return keep(self, rows, path)

    monkeypatch.setattr(DocumentIndex, "_staged", watched)
    spark.createDataFrame([(i, f"text {i % 60}", i % 7 == 0, 1) for i in range(40, 90)], schema).write.parquet(str(tmp_path / "in"))
    index.process(spark.read.schema(schema).parquet(str(tmp_path / "in")).coalesce(8), 1)
    _, verdicts, work = plans
    assert "ReadSchema" in verdicts and "text:string" not in verdicts
    assert "text:string" in work and "BroadcastHashJoin" in work and "hashpartitioning" not in work
    assert not (tmp_path / "plans" / "staged" / "batch=1").exists() and not (tmp_path / "plans" / "staged" / "batch=0").exists()
    assert {r["status"] for r in index.attempts().filter("batch = 1").collect()} == {"indexed", "refused"}
