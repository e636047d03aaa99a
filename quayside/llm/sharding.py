"""Operator 13: sharding through fixed virtual slots, in DataFrame functions only.

Every record hashes to one of some thousands of slots, whose number never changes. Bytes are added up
by slot; a stored table, one folder a version, maps slots to shards. Rebalancing edits that table: shards above
their share give up their smaller entries, and these go, largest first, to whichever shard is the lightest then. All
other entries keep their shard, so growing or shrinking moves few records.

The law is ``bytes``. A slot that weighs more than an eighth of a shard (one text may be a third of all rows) is an
entry for each of several parts, dealt by a hash of its rows. The map has a bounded number of
entries: the slots, and at most eight parts more for each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import Store

SHARDS = 24
SLOTS = 4096
PARTS_OF_A_SHARD = 8
FRAMING = 8  # bytes a record costs besides its text
CHUNK = 128  # entries whose results are appended at a time


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1, before any record is seen: equal runs of slots."""
    slot = F.col("id").cast("int").alias("slot")
    shard = F.floor(F.col("id") * shards / slots).cast("int").alias("shard")
    return spark.range(slots).select(slot, F.lit(0).alias("part"), shard, F.lit(1).alias("since"))


def loads_of(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each entry, from ``slot, part, size``."""
    return rows.groupBy("slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rebalance(mapped: DataFrame, loads: DataFrame, shards: int, version: int) -> DataFrame:
    """The map edited for these loads: ``slot, part, shard, since``, the last being the version that placed an entry.

    Entries that are new, or whose shard is gone, are placed too. Entries without bytes stay where they are. The result is as
    large as the map, and the placing is one fold over the entries given up."""
    both = mapped.join(loads, ["slot", "part"], "full").select(
        "slot", "part", F.when(F.col("shard") < shards, F.col("shard")).alias("shard"), "since", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )
    whole = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    heaviest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("whole", whole).withColumn("before", F.sum("bytes").over(heaviest))
    stays = F.col("shard").isNotNull() & ((F.col("before") * shards <= F.col("whole")) | (F.col("bytes") == 0))
    both = both.withColumn("stays", F.coalesce(stays, F.lit(False)))
    kept = both.where("stays").select("slot", "part", "shard", "since")

    # One row: the entries given up, largest first, and what the others weigh.
    given = F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot", "part", F.col("shard").alias("was"), "since"))
    held = F.when(F.col("stays") & (F.col("bytes") > 0), F.struct("shard", "bytes"))
    one = both.agg(F.sort_array(F.collect_list(given)).alias("given"), F.collect_list(held).alias("held"))

    def load(s: Column) -> Column:
        return F.aggregate(F.filter("held", lambda h: h["shard"] == s), F.lit(0).cast("long"), lambda total, h: total + h["bytes"])

    start = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(load(s).alias("load"), s.alias("shard"))))
    nothing = F.array().cast("array<int>")

    def place(state: Column, entry: Column) -> Column:
        lightest = state["loads"][0]
        heavier = F.struct((lightest["load"] - entry["less"]).alias("load"), lightest["shard"].alias("shard"))
        loads = F.array_sort(F.concat(F.slice(state["loads"], 2, shards), F.array(heavier)))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(lightest["shard"])).alias("to"))

    def place_chunk(state: Column, at: Column) -> Column:
        done = F.aggregate(F.slice("given", at, CHUNK), F.struct(state["loads"].alias("loads"), nothing.alias("to")), place)
        return F.aggregate(F.array(done), state, lambda s, d: F.struct(d["loads"].alias("loads"), F.concat(s["to"], d["to"]).alias("to")))

    chunks = F.when(F.size("given") > 0, F.sequence(F.lit(1), F.size("given"), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    to = F.aggregate(chunks, F.struct(start.alias("loads"), nothing.alias("to")), place_chunk)["to"]
    moved = one.select(F.explode(F.arrays_zip(F.col("given"), to.alias("to"))).alias("x")).select(
        "x.given.slot", "x.given.part", F.col("x.to").alias("shard"),
        F.when(F.col("x.given.was").eqNullSafe(F.col("x.to")), F.col("x.given.since")).otherwise(F.lit(version)).alias("since"),
    )
    return kept.unionByName(moved)


def save_map(mapped: DataFrame, folder: str, version: int) -> None:
    mapped.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, part int, shard int, since int").parquet(f"{folder}/version={version}")


def slotted(table: DataFrame, key: Column, size: Column, shards: int, store: Store, slots: int = SLOTS) -> DataFrame:
    """``row, size, slot, part, block, place``: the stored records with their slot, their part of it, and where they were read.

    ``row`` holds the columns of ``table``, so that none can clash. Only these travel later: leave out the texts if
    their place is all that is wanted."""
    rows = store.keep(
        table.select(
            F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row"), size.cast("long").alias("size"), slot_of(key, slots).alias("slot"),
            F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place"),
        ),
        "rows",
    )
    bytes_of = rows.groupBy("slot").agg(F.sum("size").alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / (shards * PARTS_OF_A_SHARD)
    parts = bytes_of.select("slot", F.ceil(F.col("bytes") / share).cast("int").alias("parts"))  # one row a slot
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("place"), F.col("parts"))).otherwise(0).cast("int")
    return store.keep(rows.join(F.broadcast(parts), "slot").select("row", "size", "slot", part.alias("part"), "block", "place"), "parts")


def numbered(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """The records with ``shard`` and ``number``, gapless from 0 in each shard.

    Records are numbered inside the block they were read in, which is one split of a file at most; blocks
    then follow each other. No task holds a shard."""
    rows = rows.join(F.broadcast(mapped.select("slot", "part", "shard")), ["slot", "part"])
    of_block = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    behind = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = of_block.select("shard", "block", behind.alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("place")) - 1
    rows = rows.withColumn("inside", inside).join(starts, ["shard", "block"])
    return rows.select("row", "size", "slot", "part", "shard", (F.col("start") + F.col("inside")).cast("long").alias("number"))


def shard_rows(table: DataFrame, key: Column, size: Column, store: Store, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The versions of the map are stored below ``store.base``/map; the records are placed by the last.

    The first edit places the parts of heavy slots, the second evens out with small entries what these left uneven."""
    spark, folder = table.sparkSession, f"{store.base}/map"
    rows = slotted(table, key, size, shards, store, slots)
    loads = store.keep(loads_of(rows), "loads")
    save_map(first_map(spark, shards, slots), folder, 1)
    for version in (2, 3):
        save_map(rebalance(load_map(spark, folder, version - 1), loads, shards, version), folder, version)
    return numbered(rows, load_map(spark, folder, 3))


def shard_documents(docs: DataFrame, store: Store, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot`` of every row of ``docs(doc_id, text)``.

    Equal texts share a virtual slot, and with it a shard, as long as they don't weigh more than an eighth of one. A null text
    has no bytes (checksum 0, as the empty text); null ids, repeated ids and repeated rows are rows like any others; texts
    of any length are whole records. An empty table gives no rows. Other columns are dropped."""
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + FRAMING).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    )
    placed = shard_rows(digest, F.col("text_hash"), F.col("size"), store, shards)
    return placed.select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"),
    )


def write_shards(docs: DataFrame, path: str, store: Store, shards: int = SHARDS) -> None:
    """The records themselves as Parquet, a folder ``shard=k`` for each shard, in several files by slot; columns as in ``docs``."""
    text = F.coalesce("text", F.lit(""))
    placed = shard_rows(docs, text, F.octet_length(text) + FRAMING, store, shards)
    name = "shard"
    while name in docs.columns:
        name += "_"
    deal = "deal"
    while deal in [*docs.columns, name]:
        deal += "_"
    out = placed.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("shard").alias(name), (F.col("slot") % 16).alias(deal))
    out.repartition(name, deal).drop(deal).write.partitionBy(name).parquet(path)
