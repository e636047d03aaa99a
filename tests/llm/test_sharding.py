"""Operator 13: the map's rules against plain Python, and the contract of the records."""

import zlib
from collections import Counter, defaultdict

import pytest
from helpers import CLASHES, prose, rows_of
from pyspark.sql import functions as F

from quayside.llm import sharding

MAP = "slot int, part int, shard int, since int"
LOADS = "slot int, part int, bytes long, rows long"


def plain(mapped, loads, shards, version):
    """Heavier entries stay first, what passes the mean share is placed again, largest first, on the lightest shard."""
    load = {(s, p): b for s, p, b, _ in loads}
    was = {(s, p): (k, v) for s, p, k, v in mapped}
    whole, held, kept, given = sum(load.values()), Counter(), {}, []
    by_shard = defaultdict(list)
    for e in load.keys() | was.keys():
        shard, since = was.get(e, (None, None))
        by_shard[shard if shard is not None and shard < shards else None].append((-load.get(e, 0), e, shard, since))
    for shard, entries in by_shard.items():
        before = 0
        for less, e, of, since in sorted(entries, key=lambda x: x[:2]):
            before -= less
            if shard is not None and (before * shards <= whole or less == 0):
                kept[e] = (of, since)
                held[shard] -= less
            else:
                given.append((less, e, shard, since))
    for less, e, of, since in sorted(given, key=lambda x: x[:2]):
        to = min(range(shards), key=lambda k: (held[k], k))
        held[to] -= less
        kept[e] = (to, since if of == to else version)
    return sorted((*e, *x) for e, x in kept.items())


@pytest.mark.parametrize(("slots", "shards", "to"), [(300, 7, 7), (300, 7, 8), (300, 7, 5), (5, 24, 24), (40, 1, 1)])
def test_map_is_edited_as_in_plain_python(spark, slots, shards, to):
    first = rows_of(sharding.first_map(spark, shards, slots))
    loads = [(s, p, (s * 7919 + p * 31) % 1000 + 900 * (s % 50 == 0), 1) for s in range(0, slots, 2) for p in range(3 if s % 40 == 0 else 1)]
    loads.append((1, 0, 0, 1))
    got = rows_of(sharding.rebalance(spark.createDataFrame(first, MAP), spark.createDataFrame(loads, LOADS), to, 2))
    assert sorted(got) == plain(first, loads, to, 2)


def test_growing_moves_to_the_new_shard_mostly(spark, tmp_path):
    loads = spark.createDataFrame([(s, 0, 500 + s * 37 % 300, 1) for s in range(4096)], LOADS)
    folder = str(tmp_path / "map")
    sharding.save_map(sharding.first_map(spark, 24), folder, 1)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, folder, 1), loads, 24, 2), folder, 2)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, folder, 2), loads, 25, 3), folder, 3)
    before, after = ({(s, p): k for s, p, k, _ in rows_of(sharding.load_map(spark, folder, v))} for v in (2, 3))
    moved = [e for e in after if after[e] != before[e]]
    assert len(after) == 4096 and len(moved) < 4096 / 24 + 60
    assert sum(after[e] == 24 for e in moved) > 0.8 * len(moved)
    assert {v for *_, v in rows_of(sharding.load_map(spark, folder, 3))} <= {1, 2, 3}


def check(rows, docs, shards=24):
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter(r[:3] for r in rows) == want
    assert {r[3] for r in rows} <= {"bytes"} and {r[6] for r in rows} <= {None}
    numbers, weight = defaultdict(list), Counter()
    for _, n, _, _, shard, slot, *_ in rows:
        numbers[shard].append(slot)
        weight[shard] += n
    assert set(numbers) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values())
    return [weight[k] for k in range(shards)]


def test_odd_documents(spark, store, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sharding.shard_documents(odd_docs, store)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(rows_of(got), docs)
    assert rows_of(sharding.shard_documents(no_docs, store)) == []


@pytest.mark.parametrize("hot", ["text", "row", "null"])
def test_shards_weigh_the_same_whatever_is_hot(spark, store, hot):
    docs = [(i, prose(i, 20 + i % 60)) for i in range(3000)]
    docs += [{"text": (5000 + i, prose(1, 50)), "row": (7, prose(1, 50)), "null": (None, None)}[hot] for i in range(1500)]
    got = rows_of(sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), store))
    weight = check(got, docs)
    assert max(weight) - min(weight) < 0.02 * max(weight)


def test_equal_texts_share_a_shard(spark, store):
    docs = [(i, prose(i // 6, 40)) for i in range(6000)]
    shards = defaultdict(set)
    for r in rows_of(sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), store)):
        shards[r[2]].add(r[4])
    assert len(shards) == 1000 and all(len(x) == 1 for x in shards.values())


def test_files_hold_the_records(spark, store, odd_docs, tmp_path):
    docs = odd_docs.withColumns({c: F.lit("y") for c in [*CLASHES, "shard", "deal", "size", "row"]})
    sharding.write_shards(docs, str(tmp_path / "out"), store, 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, rows_of(got.select(*docs.columns)))) == sorted(map(str, rows_of(docs)))
    assert {r["shard_"] for r in got.select("shard_").distinct().collect()} <= {0, 1, 2}


def test_no_python_worker(spark, store, odd_docs):
    plan = sharding.shard_documents(odd_docs, store)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "MapInArrow", "MapInPandas", "ExistingRDD"))
    maps = sharding.rebalance(sharding.first_map(spark, 4, 64), sharding.loads_of(spark.range(9).selectExpr("int(id) slot", "0 part", "id size")), 4, 2)
    assert "NestedLoop" not in maps._jdf.queryExecution().executedPlan().toString()
