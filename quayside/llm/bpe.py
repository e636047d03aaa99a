"""Operator 10: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The distinct pre-tokens of a text that the task doesn't know yet are laid out in one linked list of
parts. Every adjacent pair that has a merge rank waits in the bucket of that rank, as the position of
its left part. A bitmap over the ranks, with two summary levels, names the lowest rank with a waiting
pair by three find-first-set steps. An entry whose pair has changed meanwhile is stale and skipped.
Every operation is constant or logarithmic in the bucket, so a pre-token of millions of bytes takes
time in proportion to its length."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Bytes of remembered pre-tokens beyond which a pre-token isn't remembered.
LONG = 256


class RankQueue:
    """Positions by merge rank: a bucket a rank, and bitmaps of the ranks with entries."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def clear(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            bucket.append(position)

    def first(self) -> int:
        """The lowest rank with a waiting position, by find-first-set in each level; -1 if none."""
        if not (word := self.top):
            return -1
        b = (word & -word).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        return (a << 6) | ((word & -word).bit_length() - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of a vocabulary file, and the merge rank of each pair of token ids."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.size = max(self.ranks.values(), default=0) + 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # left id * 2^32 + right id
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.of_bytes = np.array([[self.pairs.get(int(a) << 32 | int(b), -1) for b in self.single] for a in self.single], np.int64)

    def _fill(self, raw: np.ndarray, ends: np.ndarray, wait: np.ndarray, queue: RankQueue) -> None:
        """Queue the adjacent bytes that can merge; ``wait`` gets the rank at each left position."""
        wait[:-1] = self.of_bytes[raw[:-1], raw[1:]]
        wait[ends - 1] = -1  # no pair reaches over the end of a pre-token
        at = np.flatnonzero(wait >= 0)
        at = at[np.argsort(wait[at], kind="stable")]
        first = np.flatnonzero(np.diff(wait[at], prepend=-1))
        for rank, positions in zip(wait[at[first]].tolist(), np.split(at, first[1:]), strict=False):
            queue.buckets[rank] = positions.tolist()
            queue.mark(rank)

    def merge(self, pretokens: list[bytes]) -> list[list[int]]:
        """Ids of each (non-empty) pre-token: lowest rank merged first, leftmost among equals."""
        whole, pairs = self.ranks.get, self.pairs.get
        found: list[list[int]] = [[] if (rank := whole(x)) is None else [rank] for x in pretokens]
        parted = [i for i, x in enumerate(found) if not x]
        if not parted:
            return found
        raw = np.frombuffer(b"".join([pretokens[i] for i in parted]), np.uint8)
        ends = np.cumsum([len(pretokens[i]) for i in parted])
        after = np.arange(1, len(raw) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(raw) - 1)
        before[ends[:-1]] = -1
        queue, wait = RankQueue(self.size), np.full(len(raw), -1)
        self._fill(raw, ends, wait, queue)
        token, after, before, wait = self.single[raw].tolist(), after.tolist(), before.tolist(), wait.tolist()
        buckets, push = queue.buckets, queue.push
        while (rank := queue.first()) >= 0:
            bucket = sorted(buckets.pop(rank))
            queue.clear(rank)
            high, lowest = rank << 32, rank
            for done, p in enumerate(bucket, 1):
                if wait[p] != rank:
                    continue  # stale: one of the two parts has been merged since
                q = after[p]
                token[p], token[q], wait[q] = rank, -1, -1
                after[p] = r = after[q]
                if r >= 0:
                    before[r] = p
                    wait[p] = other = pairs(high | token[r], -1)
                    if other >= 0:
                        push(other, p)
                        if other < lowest:
                            lowest = other
                else:
                    wait[p] = -1
                if (o := before[p]) >= 0:
                    wait[o] = other = pairs(token[o] << 32 | rank, -1)
                    if other >= 0:
                        push(other, o)
                        if other < lowest:
                            lowest = other
                if lowest < rank:  # a lower rank has come up: the rest of this bucket waits
                    for x in bucket[done:]:
                        push(rank, x)
                    break
        start = 0
        for i, end in zip(parted, ends.tolist(), strict=True):
            found[i] = [x for x in token[start:end] if x >= 0]
            start = end
        return found


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers; remembers short pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split, self.known = _vocabulary(path), _pattern(pattern).findall, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts, known = [self.split(x) if x else [] for x in texts], self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list(set().union(*parts).difference(known))
        merged = self.vocabulary.merge([x.encode("utf-8", "replace") for x in fresh])
        known.update((x, struct.pack(f"<{len(y)}I", *y)) for x, y in zip(fresh, merged, strict=True))
        out = [b"".join(map(known.__getitem__, y)) for y in parts]
        for x in fresh:
            if len(x) > LONG:
                del known[x]
        return out


def _slices(batch: pa.RecordBatch, text: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``size`` bytes of text together; a longer text is alone."""
    first, held = 0, 0
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    for i, n in enumerate(lengths):
        if i > first and held + (n or 0) > size:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n or 0
    if batch.num_rows:
        yield batch.slice(first)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace a text column by the column ``ids``: binary, little-endian unsigned 32-bit token ids.

    Other columns stay; one called like ``ids`` is replaced. Each match of ``pattern`` is encoded by
    itself; special tokens have no meaning. Null and empty texts give an empty value. A lone
    surrogate, which UTF-8 can't hold, counts as ``?``. Repeated rows are encoded each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in _slices(batch, text):
                yield _put(part, text, ids, encoder(part.column(text).to_pylist()))

    rest = [f for f in docs.schema.fields if f.name not in (text, ids)]
    return docs.drop(*({ids} - {text})).mapInArrow(run, _schema(docs, rest, ids))


def _contents(ids: list[bytes | None], table: pa.Array) -> list[bytes]:
    """The bytes of some rows of ids: taken from the table all at once, they lie one after another."""
    rows = [np.frombuffer(v or b"", "<u4") for v in ids]
    if not any(map(len, rows)):
        return [b""] * len(rows)
    found = table.take(pa.array(np.concatenate(rows)))
    if found.null_count:
        raise KeyError("an id that the vocabulary lacks")
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
    cuts = ends[np.cumsum([0, *map(len, rows)])].tolist()
    data = memoryview(found.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode(tokens: DataFrame, path: str, ids: str = "ids", content: str = "content") -> DataFrame:
    """Replace a column of ids (as ``encode`` makes them) by the bytes they stand for, in ``content``.

    An id that the vocabulary lacks fails the job; a null value gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {rank: token for token, rank in read_ranks(path).items()}
        table = pa.array([ranks.get(i) for i in range(max(ranks, default=-1) + 1)], pa.large_binary())
        for batch in batches:
            for part in _slices(batch, ids):
                yield _put(part, ids, content, _contents(part.column(ids).to_pylist(), table))

    rest = [f for f in tokens.schema.fields if f.name not in (ids, content)]
    return tokens.drop(*({content} - {ids})).mapInArrow(run, _schema(tokens, rest, content))


def _schema(df: DataFrame, rest: list, name: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{name}` binary"])


def _put(batch: pa.RecordBatch, source: str, target: str, values: list[bytes]) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (source, target)]
    return pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(values, pa.binary())], [*[n for n, _ in kept], target])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, token count, SHA-256 of the ids and of the bytes decoded from them, per document."""
    tokens = encode(docs.select("doc_id", "text"), path, pattern)
    measured = tokens.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids"
    )
    return decode(measured, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("content", 256).alias("decoded_sha256"))
