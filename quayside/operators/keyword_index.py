"""A stored keyword index over chunks, searched by block maxima.

Chunks are dealt to shards by a hash of their id and numbered inside a shard in the order of their ids. A posting block
is a row: what one term has in one run of ``SPAN`` numbers, as gaps between the numbers, counts, and the
greatest count. Postings and the directory of ids are tables bucketed by shard, so a search reads both sides of
a shard in one task, without an exchange, and no text at all.

In a shard the greatest counts of a query's terms bound what a chunk of a run can reach. Runs are looked into
from the highest bound on, until it falls below the k-th best chunk found; the blocks of all other runs are never
decoded. A shard hands on k rows a query."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.operators.retrieval import keyword_terms, lexemes
from quayside.operators.similarity import CANDIDATES, in_blocks
from quayside.session import shared_dir

SPAN = 128
ASKED = 1 << 17  # queries whose terms one job holds: some 25 MB
LISTED = 2000  # terms up to which the filter on postings is a list, else a broadcast table
FIRST_RUNS = 4
SHARD_BYTES = 16 << 20  # text of a shard
EMITTED = 1 << 16  # posting blocks handed on at once


@dataclass(frozen=True)
class KeywordIndex:
    """Names of the two tables, the number of their buckets, and how many chunk numbers a block spans."""

    postings: str  # shard, term, run, most, gaps, counts
    directory: str  # shard, number, chunk_id
    shards: int
    span: int


def build_index(chunks: DataFrame, key: str, text: Column, shards: int | None = None, folder: str | None = None, span: int = SPAN,
                least: int | None = None) -> KeywordIndex:
    """Store the index of a chunk table with unique, non-null ids.

    Without ``shards`` there are as many as keep a shard near ``SHARD_BYTES`` of text, but ``least`` (the number of shuffle partitions) at
    least, so a task's work does not grow with the table. Texts are exchanged once, by shard; in order of
    their ids they become words and posting blocks as they are read, a batch at a time."""
    spark = chunks.sparkSession
    rows = chunks.where(F.col(key).isNotNull())
    if not shards:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        shards = max(least or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    name = f"keywords_{uuid.uuid4().hex}"
    folder = folder or f"{shared_dir(spark).rstrip('/')}/{name}"
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")
    in_order = F.row_number().over(Window.partitionBy("shard").orderBy("chunk_id")) - 1

    def store(rows: DataFrame, table: str, *order: str) -> str:
        writer = rows.write.bucketBy(shards, "shard").sortBy("shard", *order).option("path", f"{folder}/{table}")
        writer.saveAsTable(f"{name}_{table}")
        return f"{name}_{table}"

    ids = rows.select(shard, F.col(key).alias("chunk_id"), text.alias("content")).repartition(shards, "shard")
    words = ids.sortWithinPartitions("shard", "chunk_id").select("shard", lexemes(F.col("content")).alias("words"))
    postings = words.mapInArrow(lambda b: _posted(b, span), "shard int, term string, run int, most int, gaps array<smallint>, counts array<int>")
    directory = ids.select("shard", in_order.alias("number"), "chunk_id")
    return KeywordIndex(store(postings, "postings", "term", "run"), store(directory, "directory", "number"), shards, span)


def _posted(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Posting blocks of chunks ``shard, words`` in order of shard and number. A task holds a batch and the chunks of an open run."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # chunks of the open run: shards, numbers, words
    last, count = -1, 0  # shard of the last chunk, and how many of its chunks were read
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.arange(len(shard))
        new = np.append(shard[0] != last, shard[1:] != shard[:-1])
        first = np.maximum.accumulate(np.where(new, row, 0))
        number = row - first + np.where((first == 0) & (not new[0]), count, 0)
        last, count = int(shard[-1]), int(number[-1]) + 1
        end = int(np.flatnonzero((shard == last) & (number // span == number[-1] // span))[0])  # the last run may go on
        if end or new[0] or not number[0] % span:
            yield from _blocks([*held, (shard[:end], number[:end], batch.column(1).slice(0, end))], span)
            held = []
        held.append((shard[end:], number[end:], batch.column(1).slice(end)))
    yield from _blocks(held, span)


def _blocks(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]], span: int) -> Iterator[pa.RecordBatch]:
    """The posting blocks of whole runs."""
    if not parts:
        return
    shard, number = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    words = pa.concat_arrays([p[2] for p in parts])
    run = np.cumsum(np.append(False, (shard[1:] != shard[:-1]) | (number[1:] // span != number[:-1] // span))[: len(shard)])
    flat = words.flatten().dictionary_encode()
    if not len(flat):
        return
    owner = np.repeat(np.arange(len(shard)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    # a word of a chunk as one number, in order of run, term and chunk
    key = (run[owner] * len(flat.dictionary) + flat.indices.to_numpy(zero_copy_only=False)) * span + (number % span)[owner]
    key, n = np.unique(key, return_counts=True)
    block, place = key // span, key % span
    start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    gaps = place - np.append(0, place[:-1])
    gaps[start] = place[start]
    of = np.zeros(int(run[-1]) + 1, np.int64)
    of[run] = np.arange(len(run))  # a chunk of each run
    of = of[block[start] // len(flat.dictionary)]
    ends = pa.array(np.append(start, len(key)), pa.int32())
    columns = [
        pa.array(shard[of], pa.int32()), flat.dictionary.take(pa.array(block[start] % len(flat.dictionary))), pa.array(number[of] // span, pa.int32()),
        pa.array(np.maximum.reduceat(n, start), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(gaps, pa.int16())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
    whole = pa.RecordBatch.from_arrays(columns, ["shard", "term", "run", "most", "gaps", "counts"])
    for at in range(0, whole.num_rows, EMITTED):
        yield whole.slice(at, EMITTED)


def keyword_search(queries: DataFrame, index: KeywordIndex, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """Chunks that hold any term, by 0.1 per matching position; the k best per query variant among the ``allowed`` ids.

    Ties go to the lower id. Variants without terms find nothing."""
    found = search(queries, index, k, allowed)
    return found.select("query_id", "variant", "chunk_id", "rank", F.round(F.col("n") * 0.1, 4).alias("keyword_score"))


def search(queries: DataFrame, index: KeywordIndex, k: int = CANDIDATES, allowed: DataFrame | None = None, block: int = ASKED) -> DataFrame:
    """``query_id, variant, chunk_id, n, rank``, and of the shard: ``blocks`` of the query's terms, and how many were ``read``."""
    spark = queries.sparkSession
    asked = queries.select("query_id", "variant", keyword_terms(F.col("text")).alias("terms"))
    return in_blocks(asked, ["query_id", "variant"], "terms", block, lambda rows: _search(spark, rows, index, k, allowed))


def _search(spark: SparkSession, rows: list, index: KeywordIndex, k: int, allowed: DataFrame | None) -> DataFrame:
    names, terms = [r[0] for r in rows], [r[1] for r in rows]
    shared = spark.sparkContext.broadcast((names, terms))
    directory, postings = spark.table(index.directory), spark.table(index.postings)
    if allowed is not None:
        directory = directory.join(allowed, "chunk_id", "left_semi")  # ids only
    wanted = sorted({t for of in terms for t in of})
    if len(wanted) <= LISTED:
        postings = postings.where(F.col("term").isin(wanted))
    else:
        postings = postings.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string")), "term", "left_semi")
    kind = spark.table(index.directory).schema["chunk_id"].dataType.simpleString()

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_of_shard(left, right, shared.value[1], k, index.span)
        ids = right.column("chunk_id").take(pa.array(found["row"], pa.int64()))
        columns = {"query": pa.array([shared.value[0][q] for q in found["query"]], pa.string()), "chunk_id": ids}
        return pa.table(columns | {c: pa.array(found[c], pa.int64()) for c in ("n", "blocks", "read")})

    groups = postings.groupBy("shard").cogroup(directory.select("shard", "number", "chunk_id").groupBy("shard"))
    found = groups.applyInArrow(shard, f"query string, chunk_id {kind}, n long, blocks long, read long")
    best = Window.partitionBy("query").orderBy(F.desc("n"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and where each row's begin."""
    whole = column.combine_chunks()
    ends = np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False))
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], ends]).astype(np.int64)


def best_of_shard(postings: pa.Table, directory: pa.Table, asked: list[list[str]], k: int, span: int = SPAN) -> dict[str, np.ndarray]:
    """The k best chunks of each query in a shard, as rows of its directory, which may hold some chunks only."""
    out: dict[str, list] = {c: [] for c in ("query", "row", "n", "blocks", "read")}
    if not postings.num_rows or not directory.num_rows:
        return {c: np.zeros(0, np.int64) for c in out}
    coded = postings.column("term").combine_chunks().dictionary_encode()
    term = np.asarray(coded.indices)
    by_term = np.argsort(term, kind="stable")
    ends = np.searchsorted(term[by_term], np.arange(len(coded.dictionary) + 1))
    rows_of = {t: by_term[ends[i] : ends[i + 1]] for i, t in enumerate(coded.dictionary.to_pylist())}
    run, most = (np.asarray(postings.column(c)).astype(np.int64) for c in ("run", "most"))
    (gaps, starts), (counts, _) = _lists(postings.column("gaps")), _lists(postings.column("counts"))
    runs = int(run.max()) + 1
    number = np.asarray(directory.column("number")).astype(np.int64)
    row_of = np.full(max(runs * span, int(number.max()) + 1), -1, np.int64)
    row_of[number] = np.arange(len(number))

    def counted(blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions by chunk in the looked-into runs, which lie one after the other as ``at`` says."""
        lengths = starts[blocks + 1] - starts[blocks]
        begin = np.cumsum(lengths) - lengths
        flat = np.arange(lengths.sum()) + np.repeat(starts[blocks] - begin, lengths)
        walked = np.cumsum(gaps[flat])
        inside = walked - np.repeat(np.concatenate([[0], walked])[begin], lengths)
        place = np.repeat(at[run[blocks]] * span, lengths) + inside
        return np.bincount(place, counts[flat], minlength=(int(at.max()) + 1) * span).astype(np.int64)

    for q, words in enumerate(asked):
        held = [rows_of[w] for w in words if w in rows_of]
        if not held:
            continue
        blocks = np.concatenate(held)
        bound = np.bincount(run[blocks], most[blocks], minlength=runs).astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, score, bar, done, step, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, FIRST_RUNS, 0
        while done < len(order) and bound[order[done]] >= bar:
            wave = order[done : done + step]
            wave = wave[bound[wave] >= bar]
            at = np.full(runs, -1, np.int64)
            at[wave] = np.arange(len(wave))
            chosen = blocks[at[run[blocks]] >= 0]
            read += len(chosen)
            n = counted(chosen, at)
            hit = np.flatnonzero(n)
            row = row_of[wave[hit // span] * span + hit % span]
            rows, score = np.concatenate([rows, row[row >= 0]]), np.concatenate([score, n[hit[row >= 0]]])
            first = np.lexsort((number[rows], -score))[:k]
            rows, score = rows[first], score[first]
            bar = int(score[-1]) if len(rows) == k else 1
            done, step = done + step, step * 4
        for c, x in zip(out, (np.full(len(rows), q), rows, score, np.full(len(rows), len(blocks)), np.full(len(rows), read)), strict=True):
            out[c].append(x)
    return {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
