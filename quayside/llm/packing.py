"""Operator 9: best-fit packing by minimum bin slack.

Only lengths matter for packing, and there are at most ``capacity`` of them. So pieces are counted by
length (a pre-aggregated shuffle), the bins are planned on that histogram, and every piece finds its
place by its rank among the pieces of its length. The plan takes the fullest feasible combination of
the lengths still available, found by a subset-sum bitset, repeats it as long as the supply lasts, and
goes on with what is left. Each combination uses up at least one length or all its copies, so the plan
has at most a few rows per length, whatever the number of documents."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import Store

CAPACITY = 2048
#: White-space-free chunks whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 600_000
#: Chunks whose tokens don't depend on more than their words: printable ASCII and Latin letters.
_PLAIN = re.compile(r"[!-;=-~A-Za-zÀ-ÖØ-öø-ÿ]*")


class Tokens(dict):
    """White-space-free chunk to its ids (little-endian unsigned 32-bit); fills itself.

    White space only separates tokens in this vocabulary, so a text's ids are those of its chunks.
    For a plain chunk the file's own split pattern and merges run without the rest of the machinery;
    any other goes through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            raw = file.read()
        spec = json.loads(raw)
        self.whole = Tokenizer.from_str(raw)
        self.model = self.whole.model
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        if bytes_["type"] != "ByteLevel" or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a vocabulary of lower-case words with byte-level pieces is expected")
        self.letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower() and _PLAIN.fullmatch(chunk):
            found = self.merged(chunk)
        elif not _PLAIN.fullmatch(chunk):
            found = np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        elif (low := chunk.lower()) != chunk:
            found = self[low]
        elif chunk[-1] in ",." and chunk[:-1].isalpha():
            found = self[chunk[:-1]] + self[chunk[-1]]  # a word and the mark after it are apart in the pattern
            if len(chunk) > 8:  # rare enough to be put together again each time
                return found
        else:
            found = b"".join(map(self.merged, self.split(chunk)))
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def merged(self, word: str) -> bytes:
        """Ids of what the split pattern takes as one."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if text.isascii() and "<" not in text:
            text = text.lower()
        return b"".join([self[x] for x in text.replace("\n", " ").split(" ") if x])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable ones stand for
    themselves, the others follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + i) for i, x in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Token ids of every document, cut into pieces of ``capacity`` tokens where it is longer.

    Returns ``doc_id, piece, start, length, ids``; ``ids`` is binary, little-endian unsigned 32-bit. A
    null text counts as empty: it is its end id alone. Lone surrogates become ``?``. Repeated rows and
    rows without an id give pieces each. Other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = _tokens(path), np.array([end], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").encode("utf-8", "replace").decode()
                ids = known.ids(text) + last
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
            names = ["doc_id", "piece", "start", "length", "ids"]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations of lengths and how often each is used: ``([(length, times), ...], bins)``.

    Each combination is the fullest that the remaining supply allows and holds the longest remaining
    length. ``reach[i]`` is a bitset of the sums that the first ``i`` lengths can make with their
    supply; the combination is read back from it, taking long lengths first."""
    left = {k: n for k, n in counts.items() if n > 0}
    plan = []
    while left:
        order = sorted(left)
        longest = order[-1]
        room = capacity - longest
        mask = (1 << (room + 1)) - 1
        usable = [x for x in order if x <= room]
        supply = {x: min(left[x] - (x == longest), room // x) for x in usable}
        reach = [1]
        for x in usable:
            bits, copies, step = reach[-1], supply[x], 1
            while copies > 0:  # binary splitting of the supply
                take = min(step, copies)
                bits |= (bits << (x * take)) & mask
                copies -= take
                step *= 2
            reach.append(bits)
        total = reach[-1].bit_length() - 1
        chosen = {longest: 1}
        for i in range(len(usable) - 1, -1, -1):
            x, times = usable[i], 0
            while times < supply[x] and total >= x * (times + 1) and any(
                total - x * k >= 0 and reach[i] >> (total - x * k) & 1 for k in range(times + 1, supply[x] + 1)
            ):
                times += 1
                if reach[i] >> (total - x * times) & 1 and not any(
                    total - x * k >= 0 and reach[i] >> (total - x * k) & 1 for k in range(times + 1, supply[x] + 1)
                ):
                    break
            while times and not reach[i] >> (total - x * times) & 1:
                times -= 1
            if times:
                chosen[x] = chosen.get(x, 0) + times
                total -= x * times
        bins = min(left[x] // k for x, k in chosen.items())
        plan.append((sorted(chosen.items(), reverse=True), bins))
        for x, k in chosen.items():
            left[x] -= bins * k
            if not left[x]:
                del left[x]
    return plan


def _slots(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """From the histogram, runs of ranks of a length: which bins they go to, and where in each."""
    counts: dict[int, int] = {}
    for batch in batches:
        for length, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[length] = counts.get(length, 0) + n
    used = dict.fromkeys(counts, 0)
    rows, first_bin = [], 0
    for combination, bins in plan_bins(counts, capacity):
        offset = 0
        for length, times in combination:
            rows.append((length, used[length], used[length] + bins * times, times, first_bin, offset))
            used[length] += bins * times
            offset += length * times
        first_bin += bins
    names = ["length", "from_rank", "to_rank", "times", "first_bin", "first_offset"]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)


def minimum_bin_slack(pieces: DataFrame, store: Store, capacity: int = CAPACITY, shares: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    All pieces are placed; offsets in a sequence run without gaps from 0. Pieces of equal length are
    interchangeable, so repeated rows and ties are placed in an arbitrary but complete way. Pieces of a
    null length or one outside the range fail the job. An empty table gives none. Columns that clash
    with ``sequence_id`` or ``offset`` are replaced.

    A length may hold most rows, so ranks within a length are dealt in ``shares`` by a hash of the
    row, each share starting where the shares before it end."""
    pieces = store.keep(
        pieces.drop("sequence_id", "offset")
        .withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length").cast("long")).otherwise(F.raise_error(F.lit("a piece's length is out of range")).cast("long")))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_share", F.pmod(F.xxhash64("_row"), F.lit(shares))),
        "pieces",
    )
    per_share = pieces.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    by_share = Window.partitionBy("length").orderBy("_share")
    starts = per_share.withColumn("_start", F.sum("_n").over(by_share) - F.col("_n"))
    # At most ``capacity`` rows of counts, whatever the input: one task plans the bins.
    histogram = per_share.groupBy("length").agg(F.sum("_n").alias("n")).repartition(1)
    slots = histogram.mapInArrow(
        lambda batches: _slots(batches, capacity),
        "length long, from_rank long, to_rank long, times long, first_bin long, first_offset long",
    )
    slots = store.keep(slots, "slots").groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "times", "first_bin", "first_offset"))).alias("_slots"))
    within = Window.partitionBy("length", "_share").orderBy("_row")
    ranked = (
        pieces.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
        .join(starts.select("length", "_share", "_start"), ["length", "_share"])
        .withColumn("_rank", F.col("_rank") + F.col("_start"))
        # At most one row per length and a few slots in it: small enough to send everywhere.
        .join(F.broadcast(slots), "length")
        .withColumn("_slot", F.filter("_slots", lambda s: (F.col("_rank") >= s["from_rank"]) & (F.col("_rank") < s["to_rank"]))[0])
    )
    turn = F.col("_rank") - F.col("_slot.from_rank")
    return ranked.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("_share", "_row")],
        (F.col("_slot.first_bin") + F.floor(turn / F.col("_slot.times"))).cast("long").alias("sequence_id"),
        (F.col("_slot.first_offset") + F.pmod(turn, F.col("_slot.times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, store: Store, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of all documents with their places; the ids themselves stay behind as a checksum.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(docs, path, capacity, end)
    return minimum_bin_slack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), store, capacity)


def sequences(docs: DataFrame, path: str, store: Store, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """The packed sequences: ``sequence_id, ids`` (binary), each of at most ``capacity`` tokens."""
    packed = minimum_bin_slack(token_pieces(docs, path, capacity, end), store, capacity)
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    hexes = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return parts.select("sequence_id", F.unhex(hexes).alias("ids"))
