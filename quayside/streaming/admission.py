"""Sliding-window admission: at most ``limit`` accepted hits per key within a window.

A hit is judged by the accepted hits before it. The batch job first cuts every key's hits at pauses of a whole
window, where nothing can carry over, and works the stretches off in parallel; a stretch passes a task as a
sorted stream of which only ``limit`` times are kept. A stretch of very many hits, of a key that never pauses,
is cut into blocks too. These run side by side, at first as if nothing had been accepted before; each is run again
from what its predecessor left, until no block's start changes any more. What is left then is the sequential result,
for the first block starts right and every other one where its predecessor ends. Stretches that don't
settle within ``ROUNDS`` go through one task each.

The stream keeps a key's accepted times as list state and drops them by an event-time timer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quayside.operators.carry import last_before
from quayside.session import shared_dir

MICROS = 1_000_000
BLOCK_SECONDS = 60  # hits of one key and minute are sorted in one task
BLOCK_HITS = 1 << 17  # hits of a stretch beyond which it is cut into blocks of about as many
ROUNDS = 4
STATE = -(2**62)  # time of the row that carries a block's start
LATE = "1 day"


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def judge(times: np.ndarray, kept: list[int], limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Accepted flags and retry times of sorted hits; ``kept`` holds accepted times and is updated.

    Rejected runs are skipped by binary search, so the loop runs once per accepted hit."""
    accepted = np.zeros(len(times), dtype=bool)
    retry = np.zeros(len(times), dtype=np.int64)
    i = 0
    while i < len(times):
        now = int(times[i])
        while kept and kept[0] <= now - window:
            kept.pop(0)
        if len(kept) < limit:
            accepted[i] = True
            kept.append(now)
            i += 1
            continue
        # Everything before the oldest accepted hit expires is rejected.
        end = int(np.searchsorted(times, kept[0] + window, side="left"))
        wait = kept[0] + window - times[i:end]
        retry[i:end] = np.maximum(1, -(-wait // MICROS))
        i = end
    return accepted, retry


def _stretches(hits: DataFrame, window: int) -> DataFrame:
    """Number the stretches of each key that no pause of a whole window interrupts.

    Pauses are found block-wise, so that a key with very many hits is no single task."""
    block = min(window, BLOCK_SECONDS * MICROS)
    marked = last_before(hits, ["key"], "at", F.col("at"), "_previous", block=block)
    starts = marked.withColumn("_start", F.when(
        F.col("_previous").isNull() | (F.col("at") - F.col("_previous") >= window), F.col("at")))
    opened = last_before(starts, ["key"], "at", F.col("_start"), "_opened", block=block)
    return opened.withColumn("stretch", F.coalesce("_start", "_opened")).drop("_previous", "_start", "_opened")


def _complete(hits: DataFrame, key: str, ts: str, hit_id: str) -> tuple[DataFrame, DataFrame]:
    """Hits that can be judged, and the result rows of those without a key or a time: not accepted, and
    without a time after which to retry, since waiting would not help."""
    timed = hits.select(F.col(hit_id).alias("hit"), F.col(key).alias("key"), micros(ts).alias("at"))
    lacking = F.col("key").isNull() | F.col("at").isNull()
    refused = timed.where(lacking).select(F.col("hit").alias(hit_id), F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("retry_after"))
    return timed.where(~lacking), refused


def _walk(batches: Iterator[pd.DataFrame], limit: int, window: int, ends: bool) -> Iterator[pd.DataFrame]:
    """Judge rows ``key, stretch, block, at, hit, kept`` in this order; a row at ``STATE`` sets what a block starts with.

    With ``ends`` only what is kept at the end of each block is told."""
    current, kept = None, []
    for batch in batches:
        columns = [batch[c].to_numpy() for c in ("key", "stretch", "block", "at")]
        at = columns[3]
        new = np.zeros(len(batch), bool)
        for c in columns[:3]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new).tolist()
        accepted, retry, told = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64), []
        for start, end in zip([0, *cuts], [*cuts, len(batch)]):
            if start == end:
                continue
            name = tuple(c[start] for c in columns[:3])
            if current != name:
                if current is not None:
                    told.append((*current, kept))
                current, kept = name, []
            if at[start] == STATE:
                kept = [int(x) for x in batch["kept"].iloc[start]]
                start += 1
            accepted[start:end], retry[start:end] = judge(at[start:end], kept, limit, window)
        if ends:
            yield pd.DataFrame(told, columns=["key", "stretch", "block", "kept"])
        else:
            hit = at != STATE
            yield pd.DataFrame({"hit": batch["hit"].to_numpy()[hit], "accepted": accepted[hit], "retry": retry[hit]}).astype({"hit": "int64"})
    if ends and current is not None:
        yield pd.DataFrame([(*current, kept)], columns=["key", "stretch", "block", "kept"])


ROW = ["key", "stretch", "block", "at", "hit", "kept"]


def _ordered(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Rows of blocks in order, behind the rows that carry their starts."""
    rows = rows.select(*ROW[:5], F.lit(None).cast("array<bigint>").alias("kept"))
    if starts is not None:
        rows = rows.union(starts.select(*ROW[:3], F.lit(STATE), F.lit(None).cast("bigint"), F.col("start")))
    return rows.repartition("key", "stretch", "block").sortWithinPartitions(*ROW[:5])


def _in_blocks(rows: DataFrame, limit: int, window: int, block_hits: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows with their block, and the true start of every block that has one to start from."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/admission-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    of = ["key", "stretch"]
    rows = keep(rows.select(*of, "at", "hit"), "hits")
    sizes = rows.groupBy(*of).agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("n") > block_hits)
    span = F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / block_hits))
    spans = keep(sizes.select(*of, "low", span.cast("bigint").alias("span")), "spans")
    rows = rows.join(spans, of, "left").select(*of, F.coalesce(F.floor((F.col("at") - F.col("low")) / F.col("span")), F.lit(0)).cast("bigint").alias("block"), "at", "hit", F.col("span").isNotNull().alias("long"))
    rows = keep(rows, "rows")
    long = rows.where("long")
    key = long.schema["key"].dataType.simpleString()
    ended = f"key {key}, stretch bigint, block bigint, kept array<bigint>"
    first_at = long.groupBy(*ROW[:3]).agg(F.min("at").alias("first"))
    ends = _ordered(long).mapInPandas(lambda b: _walk(b, limit, window, True), ended).join(first_at, ROW[:3])
    nothing = F.array().cast("array<bigint>")
    ends = keep(ends.withColumn("start", nothing), "ends-0")
    before = F.lag("kept").over(Window.partitionBy(*of).orderBy("block"))
    live = F.filter(F.coalesce(F.col("_before"), nothing), lambda x: x > F.col("first") - window)
    for step in range(1, ROUNDS + 1):
        state = ends.withColumn("_before", before).withColumn("due", live).drop("_before")
        changed = keep(state.where("due <> start").select(*ROW[:3], "first", F.col("due").alias("start")), f"changed-{step}")
        if changed.isEmpty():
            return rows, ends.where(F.size("start") > 0)
        again = _ordered(long.join(changed, ROW[:3], "left_semi"), changed).mapInPandas(lambda b: _walk(b, limit, window, True), ended)
        again = again.join(changed.select(*ROW[:3], "first", "start"), ROW[:3])
        ends = keep(ends.join(changed, ROW[:3], "left_anti").unionByName(again), f"ends-{step}")
    state = ends.withColumn("_before", before).withColumn("due", live)
    open_ = keep(state.where("due <> start").select(*of).distinct().withColumn("open", F.lit(True)), "open")
    rows = rows.join(open_, of, "left").withColumn("block", F.when(F.col("open"), F.lit(0)).otherwise(F.col("block")).cast("bigint"))
    return rows, ends.where(F.size("start") > 0).join(open_, of, "left_anti")


def admit(hits: DataFrame, key: str, ts: str, hit_id: str, limit: int, window_seconds: float, block_hits: int = BLOCK_HITS) -> DataFrame:
    """Every hit with ``accepted`` and ``retry_after`` (seconds, null when accepted).

    A hit without a key or a time is not accepted, with a null ``retry_after``."""
    window = int(window_seconds * MICROS)
    timed, refused = _complete(hits, key, ts, hit_id)
    # Hits of one key at the same instant share a stretch: number the instants, then join the hits back.
    instants = _stretches(timed.select("key", "at").distinct(), window)
    rows, starts = timed.join(instants, ["key", "at"]).withColumn("block", F.lit(0).cast("bigint")), None
    most = timed.groupBy("key").count().agg(F.max("count")).first()[0]  # no stretch is longer
    if (most or 0) > block_hits:
        rows, starts = _in_blocks(rows, limit, window, block_hits)
    judged = _ordered(rows, starts).mapInPandas(lambda b: _walk(b, limit, window, False), "hit bigint, accepted boolean, retry bigint")
    return judged.select(F.col("hit").alias(hit_id), "accepted", F.when(~F.col("accepted"), F.col("retry")).alias("retry_after")).union(refused)


class _Admission(StatefulProcessor):
    """Accepted times of a key as list state; a timer drops them once the watermark has passed the last one's window."""

    def __init__(self, limit: int, window: int, evict_idle: bool) -> None:
        self.limit, self.window, self.evict_idle = limit, window, evict_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [int(x[0]) for x in self.kept.get()]
        parts = [(batch["at"].to_numpy(), batch["hit"].to_numpy()) for batch in rows]  # two numbers a hit of the micro-batch
        at, hit = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((hit, at))
        for k in range(0, len(order), SLICE):
            some = order[k : k + SLICE]
            accepted, retry = judge(at[some], kept, self.limit, self.window)
            yield pd.DataFrame({"hit": hit[some], "accepted": accepted, "retry": retry})
        self.kept.put([(x,) for x in kept])
        if self.evict_idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((kept[-1] + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


SLICE = 10_000  # hits of a key handed on at a time


def admit_stream(hits: DataFrame, key: str, ts: str, hit_id: str, limit: int, window_seconds: float,
                 evict_idle: bool = True, late: str = LATE) -> DataFrame:
    """The same as a stateful stream: the state of a key is its accepted times of one window.

    Hits of a micro-batch are judged in time order, one that comes late when it arrives; Spark drops hits that are later than ``late``.
    A key leaves the state when the watermark passes its last accepted hit by a window, unless ``evict_idle`` is off."""
    window = int(window_seconds * MICROS)
    named = hits.select(F.col(hit_id).alias("hit"), F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    lacking = F.col("key").isNull() | F.col("ts").isNull()
    refused = named.where(lacking).select(F.col("hit").alias(hit_id), F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("retry_after"))
    timed = named.where(~lacking).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    judged = timed.groupBy("key").transformWithStateInPandas(
        _Admission(limit, window, evict_idle), "hit bigint, accepted boolean, retry bigint", "Append", "EventTime")
    judged = judged.select(F.col("hit").alias(hit_id), "accepted", F.when(~F.col("accepted"), F.col("retry")).alias("retry_after"))
    return judged.union(refused)
