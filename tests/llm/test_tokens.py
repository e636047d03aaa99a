"""Operators 9 and 10: byte-level BPE against the reference library, packing against its contract."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import SF, rows_of
from tokenizers import Tokenizer

from quayside.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_texts(library):
    encoder, order = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    texts = ["".join(order.choice("aabcAB  é日本\n\t'stre9́ ") for _ in range(order.randrange(90))) for _ in range(800)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "the" * 9_000, "abcab" * 5_000, " " * 5_000 + "x"])
def test_bpe_of_very_long_pretokens(library, text):
    (ids,) = bpe.Encoder(RANKS, public_tokenizers.PATTERN)([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_forgets_without_harm(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("one two three four five", "five six one", "one two"):
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_rank_queue_gives_the_lowest_rank():
    queue, order = bpe.RankQueue(70_000), random.Random(1)
    ranks = [order.randrange(70_000) for _ in range(500)]
    for p, r in enumerate(ranks):
        queue.push(r, p)
    seen = []
    while (r := queue.first()) >= 0:
        seen += [r] * len(queue.buckets.pop(r))
        queue.clear(r)
    assert seen == sorted(ranks)


def test_round_trip_of_a_table(spark, odd_docs, library):
    got = sorted(rows_of(bpe.round_trip(odd_docs, RANKS, public_tokenizers.PATTERN)), key=str)
    want = []
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_of_no_rows(no_docs):
    assert rows_of(bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN)) == []


def test_encode_keeps_other_columns(odd_docs):
    out = bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN)
    assert {"doc_id", "n", "cluster"} <= set(out.columns) and "text" not in out.columns and out.count() == odd_docs.count()


def test_word_ids_equal_the_library(spark):
    tokens, library = packing.Tokens(WORDS), Tokenizer.from_file(WORDS)
    order = random.Random(2)
    texts = ["".join(order.choice([*"aabcABÉéÀßÿ  日本\n\t'stre9́ <|>ſİ.!-­\x1c", "<|endoftext|>", "'s", "'ll"]) for _ in range(order.randrange(30))) for _ in range(800)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_plan_fills_each_bin_as_full_as_it_can():
    def fullest(lengths, capacity):
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= capacity}
        return max(sums)

    order = random.Random(4)
    for _ in range(60):
        lengths = [order.randint(1, 30) for _ in range(order.randint(1, 14))]
        plan = packing.plan_bins(Counter(lengths), 30)
        left = sorted(lengths)
        for combination, bins in plan:
            for k in range(bins):
                flat = [x for x, times in combination for _ in range(times)]
                longest = max(left)
                rest = left.copy()
                rest.remove(longest)
                assert longest in flat
                if k == 0:
                    assert sum(flat) == longest + fullest(rest, 30 - longest)
                for x in flat:
                    left.remove(x)
        assert not left


def test_packing_of_a_table(spark, odd_docs, store):
    got = packing.pack_documents(odd_docs, WORDS, store, capacity=64).collect()
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in odd_docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[r["doc_id"], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    total = sum(k[3] * n for k, n in want.items())
    assert len(sequences) <= -(-total // 64) * 1.02 + 1


def test_packing_of_no_rows(no_docs, store):
    assert rows_of(packing.pack_documents(no_docs, WORDS, store)) == []


def test_sequences_hold_the_ids(spark, store):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "")], "doc_id long, text string")
    library = Tokenizer.from_file(WORDS)
    want = sorted(x for t in ("a b c", "d e", "") for x in [*library.encode(t, add_special_tokens=False).ids, 0])
    rows = packing.sequences(docs, WORDS, store, capacity=16).collect()
    assert len(rows) == 1 and sorted(np.frombuffer(rows[0]["ids"], "<u4").tolist()) == want


def test_a_piece_of_no_length_fails(spark, store):
    with pytest.raises(Exception, match="out of range"):
        packing.minimum_bin_slack(spark.createDataFrame([(1, 0)], "doc_id long, length long"), store).count()


def test_contents_of_ids_are_those_of_the_table():
    """Rows of ids next to null and empty ones; an id without a token, or beyond the table, fails."""
    table = pa.array([b"a", b"", b"\xff\x00", None], pa.large_binary())
    coded = [np.array(x, "<u4").tobytes() for x in ([0, 2, 1, 0], [], [2])]
    assert bpe._contents([coded[0], None, coded[1], coded[2]], table) == [b"a\xff\x00a", b"", b"", b"\xff\x00"]
    assert bpe._contents([None, b""], table) == [b"", b""]
    for lacking in (3, 4):
        with pytest.raises((KeyError, IndexError)):
            bpe._contents([np.array([0, lacking], "<u4").tobytes()], table)
