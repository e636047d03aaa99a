"""Operator 8: language-model score of whole texts by a subword lattice.

The model draws pieces of an existing vocabulary independently until it draws the end. A text's
probability is the sum over all its segmentations; the forward recursion in log space gives it. Every
word starts with the word mark and no piece reaches over one, so the lattice of a text is the chain of
the lattices of its words: a word's marginal is computed once per distinct word, wherever it stands.
A character may also be spelled by its byte pieces, so no text is impossible.

The vocabulary's scores (merge order: the piece at place r counts as 1 / (r + 10)) weight the
segmentations of the training words; the expected counts of the pieces, by the forward and backward
recursions over every training word, are the model's probabilities.

Texts are read once. A task numbers the words of a block of documents and writes the numbered texts
and, apart from them, one row per distinct word of the block. Only those rows are shuffled, once by word,
where they get their counts, and once back, packed by block, to meet the block's texts again."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import Store, to_batch, words

BLOCK = 8_000_000  # characters; a longer text is a block by itself
PLACE_BITS = 28  # of a word's number in its block; a block's own number is the rest of a place
HOT_BLOCKS, HOT_SAMPLE, HOT_BYTES, MOST_HOT, SHARES = 100_000, 64, 64, 10_000, 64  # words dealt by block too, see ``_hot_words``
SHORT = 48  # characters of words that are worked off together
BATCH = 1 << 16  # rows worked off together
MARK = "▁"
PRIOR = 0.1  # of a piece's first weight, in counts per piece


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and first log weights (adding up to one); the 256 byte pieces come last, before the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, places = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and MARK not in piece[1:]:
            pieces.append(piece)
            places.append(max(0.0, -model.get_score(i)))
    weight = 1 / (np.array(places + [max(places, default=0.0)] * 257) + 10)
    return pieces, np.log(weight / weight.sum())


class Lattice:
    """Segmentations of words into pieces with log weights (pieces, then 256 bytes, then the end).

    Words of one length are worked off together, place by place; long words one by one."""

    BITS, BASE = 20, 0x100000001B3

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.pieces, self.logs, self.longest = pieces, logs, max(map(len, pieces), default=1)
        self._table()
        self.table: dict[str, tuple[float, int] | None] = {}
        values = logs.tolist()
        for k, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                self.table.setdefault(piece[:cut], None)
        for k, piece in enumerate(pieces):
            self.table[piece] = (values[k], k)
        self.bytes, self.first_byte = values[len(pieces) : len(pieces) + 256], len(pieces)
        self.end = values[-1]
        self.missing = object()

    def edges(self, text: str) -> list[list[tuple[int, float, int]]]:
        """For each end of a piece, the pieces that end there: start, log weight, number (-1: bytes)."""
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(text) + 1)]
        get, missing, n = self.table.get, self.missing, len(text)
        for i, char in enumerate(text):
            into[i + 1].append((i, sum([self.bytes[x] for x in char.encode("utf-8", "surrogatepass")]), -1))
            j = i + 1
            while j <= n and (found := get(text[i:j], missing)) is not missing:
                if found is not None:
                    into[j].append((i, *found))
                j += 1
        return into

    def forward(self, into: list[list[tuple[int, float, int]]]) -> list[float]:
        """Log of the summed weights of all segmentations up to each place."""
        alpha = [0.0]
        for arrive in into[1:]:
            terms = [alpha[i] + w for i, w, _ in arrive]
            top = max(terms)
            alpha.append(top if len(terms) == 1 else top + math.log(sum([math.exp(x - top) for x in terms])))
        return alpha

    def _long_expect(self, text: str, times: float, counts: np.ndarray) -> None:
        into = self.edges(text)
        alpha = self.forward(into)
        inside = [0.0] * len(alpha)  # share of all segmentations that pass each place
        inside[-1] = 1.0
        for j in range(len(into) - 1, 0, -1):
            for i, w, k in into[j]:
                share = inside[j] * math.exp(min(0.0, alpha[i] + w - alpha[j]))
                inside[i] += share
                for x in [k] if k >= 0 else [self.first_byte + y for y in text[i].encode("utf-8", "surrogatepass")]:
                    counts[x] += share * times

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; -1 for others."""
        at = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)
        found = np.where(self.keys[at] == h, self.numbers[at], -1)
        for k in range(1, self.probes):  # displaced by another piece
            again = (at + np.uint64(k)) & np.uint64((1 << self.BITS) - 1)
            found = np.where((found < 0) & (self.keys[again] == h), self.numbers[again], found)
        return found

    def _table(self) -> None:
        self.keys, self.numbers = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for number, piece in enumerate(self.pieces):
            h = 0
            for char in piece:
                h = (h * self.BASE + ord(char) + 1) & (2**64 - 1)
            at, k = (h * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - self.BITS), 0
            while self.numbers[(at + k) % (1 << self.BITS)] >= 0:
                k += 1
            self.keys[(at + k) % (1 << self.BITS)], self.numbers[(at + k) % (1 << self.BITS)] = h, number
            self.probes = max(self.probes, k + 1)

    def _groups(self, found: list[bytes]):
        """Words of equal length together, as rows of characters; long ones one by one."""
        texts = [MARK + w.decode("utf-8", "surrogatepass") for w in found]
        by: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            by.setdefault(len(text), []).append(k)
        for n, of in by.items():
            if n > SHORT:
                for k in of:
                    yield n, [k], texts[k]
            else:
                flat = "".join([texts[k] for k in of]).encode("utf-32-le", "surrogatepass")
                yield n, of, np.frombuffer(flat, "<u4").reshape(len(of), n)

    def _paths(self, chars: np.ndarray):
        """Forward sums of words of one length, and all pieces in them: start, end, rows, weights, numbers.

        The bytes of a character are a piece without a number (-1)."""
        size, n = chars.shape
        kinds, of = np.unique(chars, return_inverse=True)
        spelled = np.array([sum([self.bytes[x] for x in chr(c).encode("utf-8", "surrogatepass")]) for c in kinds.tolist()])[of.reshape(size, n)]
        alpha = np.full((n + 1, size), -np.inf)
        alpha[0] = 0
        edges = []
        everyone = np.arange(size)
        values = chars.astype(np.uint64) + np.uint64(1)
        for i in range(n):
            edges.append((i, i + 1, everyone, spelled[:, i], np.full(size, -1)))
            h = np.zeros(size, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * np.uint64(self.BASE) + values[:, j - 1]
                number = self._find(h)
                rows = np.flatnonzero(number >= 0)
                if len(rows):
                    edges.append((i, j, rows, self.logs[number[rows]], number[rows]))
        for i, j, rows, weights, _ in edges:  # starts in order, so alpha[i] is complete
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + weights)
        return alpha, edges

    def marginals(self, found: list[bytes]) -> np.ndarray:
        """Log of the summed weights of all segmentations of each word."""
        out = np.zeros(len(found))
        for _, of, chars in self._groups(found):
            out[of] = self.forward(self.edges(chars))[-1] if isinstance(chars, str) else self._paths(chars)[0][-1]
        return out

    def expect(self, found: list[bytes], times: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected number of each piece in so many of each word, by forward and backward sums."""
        for n, of, chars in self._groups(found):
            if isinstance(chars, str):
                self._long_expect(chars, float(times[of[0]]), counts)
                continue
            alpha, edges = self._paths(chars)
            inside = np.zeros_like(alpha)
            inside[n] = 1
            numbers, amounts = [], []
            for i, j, rows, weights, number in sorted(edges, key=lambda e: -e[1]):  # ends in falling order
                share = inside[j, rows] * np.exp(np.minimum(0.0, alpha[i, rows] + weights - alpha[j, rows]))
                inside[i, rows] += share
                amount = share * times[of][rows]
                if number[0] >= 0:
                    numbers.append(number)
                    amounts.append(amount)
                else:
                    kinds, at = np.unique(chars[:, i], return_inverse=True)
                    for c, total in zip(kinds.tolist(), np.bincount(at, amount).tolist(), strict=True):
                        for x in chr(c).encode("utf-8", "surrogatepass"):
                            counts[self.first_byte + x] += total
            if numbers:
                counts += np.bincount(np.concatenate(numbers), np.concatenate(amounts), len(counts))


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("word", pa.binary()), ("place", pa.int64()), ("n_train", pa.int64()),
    ("rows", pa.int32()), ("sizes", pa.binary()), ("held", pa.binary()), ("tokens", pa.binary()),
])


def _number(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: a row with the numbered texts, and a row per distinct word."""
    schema = _BLOCKS.append(pa.field("ids", pa.list_(id_type)))
    first = TaskContext.get().partitionId() << 12  # blocks of a task; a place is a block and the number of a word in it
    ids, held, sizes, tokens, numbers, size, block = [], [], [], [], {}, 0, 0

    def written() -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(tokens) if tokens else np.zeros(0, "<u4")
        train = np.repeat(~np.array(held, bool), sizes)
        n = np.bincount(flat[train], minlength=len(numbers))
        whole = (first + block, None, None, None, len(ids), np.array(sizes, "<u4").tobytes(), np.array(held, "u1").tobytes(), flat.tobytes(), ids)
        yield to_batch([whole], schema)
        listed = list(numbers)
        for at in range(0, len(listed), 50_000):
            part = listed[at : at + 50_000]
            k = len(part)
            columns = [pa.nulls(k, pa.int64()), pa.array(part, pa.binary()), pa.array(((first + block) << PLACE_BITS) + np.arange(at, at + k)), pa.array(n[at : at + k])]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(k, f.type) for f in list(schema)[4:]], schema=schema)

    for batch in batches:
        for doc, text, is_held in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if ids and size + len(text or "") > BLOCK:
                yield from written()
                ids, held, sizes, tokens, numbers, size, block = [], [], [], [], {}, 0, block + 1
            found = words(text)
            put = numbers.setdefault
            tokens.append(np.array([put(w, len(numbers)) for w in found], "<u4"))
            ids.append(doc)
            held.append(is_held)
            sizes.append(len(found))
            size += len(text or "")
    if ids:
        yield from written()


def score_documents(docs: DataFrame, held_out: F.Column, path: str, store: Store) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``docs`` has ``doc_id, text`` and the columns that ``held_out`` uses; rows where that is not true are
    learned from. ``base_score`` is the smoothed unigram model of whole words, ``score`` the lattice
    model's log10 probability. A null text counts as empty: it is the end token alone. Without
    training rows the first weights stay. Repeated rows count and are scored each; other columns
    are dropped. Lone surrogates are kept as they are."""
    kind = docs.schema["doc_id"].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    id_name = {"int64": "bigint", "int32": "int"}.get(str(id_type), "string")
    fields = "block long, word binary, place long, n_train long, rows int, sizes binary, held binary, tokens binary"
    chosen = docs.select(F.col("doc_id").cast(id_name), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    numbered = store.keep(chosen.mapInArrow(lambda b: _number(b, id_type), f"{fields}, ids array<{id_name}>"), "numbered")
    texts = numbered.where("word is null").select("block", "sizes", "held", "tokens", "ids")

    # A word has a row per block. One in very many blocks is dealt by block too, and its total is added up apart.
    counted = numbered.where("word is not null").select("word", "place", "n_train")
    hot = _hot_words(counted, store)
    share = F.when(F.col("hot_c").isNotNull(), F.pmod(F.xxhash64("place"), F.lit(SHARES))).otherwise(0)
    counted = counted.join(F.broadcast(hot), "word", "left").withColumn("share", share)
    of_word = Window.partitionBy("word", "share")
    counted = counted.select(
        "word", "place", F.coalesce("hot_c", F.sum("n_train").over(of_word)).alias("c"),
        (F.col("hot_c").isNull() & (F.row_number().over(of_word.orderBy("place")) == 1)).alias("first"),
    )
    counted = store.keep(counted, "counted")  # its files are sorted by word
    once = counted.where("first").select("word", "c").union(hot).where("c > 0")
    totals = once.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ended = texts.mapInArrow(_train_documents, "n long").agg(F.sum("n")).first()[0] or 0
    n_train = (totals["n"] or 0) + ended
    distinct = (totals["v"] or 0) + (ended > 0)

    pieces, logs = vocabulary(path)
    expected = once.select("word", "c").mapInArrow(lambda b: _expect(b, path), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(logs))
    for row in expected.collect():  # a row for each piece of the vocabulary at most
        counts[row["piece"]] = row["n"]
    counts[-1] = ended
    fitted = counts + PRIOR * len(logs) * np.exp(logs)
    logs = np.log(fitted / fitted.sum())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logs)
        for table in _together(batches):
            word = table.column("word").combine_chunks().dictionary_encode()  # sorted, so equal words are near
            log10 = (lattice.marginals(word.dictionary.to_pylist()) / math.log(10))[word.indices.to_numpy()]
            place, c = table.column("place").to_numpy(), table.column("c").to_numpy()
            order = np.argsort(place, kind="stable")
            blocks, first = np.unique(place[order] >> PLACE_BITS, return_index=True)
            parts = np.split(order, first[1:])
            packed = [[x[p].astype(kind).tobytes() for p in parts] for x, kind in ((place & ((1 << PLACE_BITS) - 1), "<u4"), (c, "<i8"), (log10, "<f8"))]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *[pa.array(x, pa.binary()) for x in packed]], ["block", "slot", "c", "log10"])

    back = counted.select("word", "place", "c").mapInArrow(judged, "block long, slot binary, c binary, log10 binary")
    back = back.groupBy("block").agg(F.collect_list(F.struct("slot", "c", "log10")).alias("of"))
    end = (math.log10((ended + 0.5) / (n_train + 0.5 * (distinct + 1))), float(logs[-1]) / math.log(10), ended > 0)
    names = f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    result = texts.join(back, "block", "left").mapInArrow(lambda b: _scores(b, id_type, n_train, distinct, end), names)
    return result.select(F.col("doc_id").cast(kind), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_words(counted: DataFrame, store: Store) -> DataFrame:
    """``word, hot_c``: words in about ``HOT_BLOCKS`` blocks or more, which one task should not take, with their training count.

    One row in ``HOT_SAMPLE`` tells which these are, ``MOST_HOT`` of up to ``HOT_BYTES`` bytes at most: under 1 MB to broadcast. Their
    counts are added up over all rows, in parts first. All other words are counted by word."""
    asked = counted.where((F.pmod(F.xxhash64("place"), F.lit(HOT_SAMPLE)) == 0) & (F.octet_length("word") <= HOT_BYTES))
    asked = asked.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SAMPLE > HOT_BLOCKS)
    hot = store.keep(asked.orderBy(F.desc("n"), "word").limit(MOST_HOT).select("word"), "hot")
    if hot.isEmpty():
        return hot.select("word", F.lit(0).cast("long").alias("hot_c"))
    return store.keep(counted.join(F.broadcast(hot), "word").groupBy("word").agg(F.sum("n_train").alias("hot_c")), "hot-counts")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to at least ``BATCH`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _train_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [x.count(b"\0") for x in batch.column(batch.schema.get_field_index("held")).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])


def _expect(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    lattice, logs = Lattice(*vocabulary(path)), vocabulary(path)[1]
    counts = np.zeros(len(logs))
    for table in _together(batches):
        lattice.expect(table.column("word").to_pylist(), table.column("c").to_numpy().astype(float), counts)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["piece", "n"])


def _scores(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, n_train: int, distinct: int, end: tuple) -> Iterator[pa.RecordBatch]:
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    base = math.log10(n_train + 0.5 * (distinct + 1))
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            sizes = np.frombuffer(columns["sizes"][i].as_py(), "<u4")
            tokens = np.frombuffer(columns["tokens"][i].as_py(), "<u4")
            held = np.frombuffer(columns["held"][i].as_py(), "u1").astype(bool)
            of = columns["of"].slice(i, 1).flatten()
            slot, c_of, log10_of = [np.frombuffer(b"".join(of.field(x).to_pylist()), kind) if len(of) else np.zeros(0, kind) for x, kind in (("slot", "<u4"), ("c", "<i8"), ("log10", "<f8"))]
            c, log10 = np.zeros(len(slot)), np.zeros(len(slot))
            c[slot], log10[slot] = c_of, log10_of
            owner = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(owner, x[tokens], len(sizes))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(
                    [columns["ids"][i].as_py(), held, sizes.astype(np.int64) + 1, add((c > 0).astype(float)).astype(np.int64) + end[2],
                     add(np.log10(c + 0.5) - base) + end[0], add(log10) + end[1]], types, strict=True)],
                names,
            )
