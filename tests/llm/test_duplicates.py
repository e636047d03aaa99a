"""Operators 4 and 6 against brute force on small tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, clashing, prose, rows_of

from quayside.llm import ngram_join, substring
from quayside.llm.common import components, words


def smallest(n, links):
    low = {x: x for x in n}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a != b and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    return smallest({i for i, _ in sets}, links)


def copies():
    """Groups of near copies around one text: some linked to the first only through others."""
    rows, doc = [], 0
    for group in range(4):
        base = prose(100 + group, 60 + 300 * group).split()
        for k in range(12):
            w = list(base)
            for j in range(k // 2):
                w[(7 * j + 3 * k) % len(w)] = f"new{k}{j}"
            rows.append((1000 - doc, " ".join(w)))
            doc += 1
    rows += [(2000 + k, prose(500 + k, 40)) for k in range(20)]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, store, width, percent):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, store, width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_of_large_clusters_in_blocks(spark, store, monkeypatch):
    """A group of more copies than a block holds, and its looser ends, are still joined exactly."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    base = prose(1, 90).split()
    rows = []
    for k in range(70):
        w = list(base)
        for j in range(1 + k % 4):
            w[(11 * j + k) % 90] = f"n{k % 9}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, store).collect()}
    assert got == brute_components(rows, 3, 90)


def test_jaccard_on_odd_rows(odd_docs, store):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = ngram_join.jaccard_components(odd_docs, store).collect()
    want = brute_components(rows, 3, 90)
    assert len(got) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    sizes = {(i, len(shingles(t, 3))) for i, t in rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_jaccard_of_no_rows(no_docs, store):
    assert rows_of(ngram_join.jaccard_components(no_docs, store)) == []


def test_signatures_meet_wherever_sets_are_similar():
    """Rare and frequent n-grams, small, paired and large sets, at the limits between them."""
    order = np.random.default_rng(1)
    for n in (9, 40, 63, 64, 71, 300, 1900, 2047, 2300):
        for share in (0.0, 0.5, 0.95, 1.0):
            base = order.integers(0, 2**63, n * 2, dtype=np.uint64)
            levels = np.where(order.random(1 << ngram_join.CELL_BITS) < share, 50, 1).astype(np.uint16)
            for percent in (90, 80):
                a = np.unique(base[:n])
                lack = ngram_join.lacking(n, percent)
                b = np.unique(np.concatenate([a[: n - lack // 2], base[n : n + lack // 2]]))
                k = len(np.intersect1d(a, b))
                if 100 * k >= percent * (len(a) + len(b) - k):
                    x, y = (ngram_join.signatures(s, levels, 10, percent) for s in (a, b))
                    assert len(np.intersect1d(x, y)), (n, share, percent)


def test_components_of_a_path_and_a_star(spark, store):
    path = [(k, k + 1) for k in range(30)]
    star = [(100, 100 + k) for k in range(1, 200)]
    odd = [(None, 3), (500, 500)]
    got = dict(rows_of(components(spark.createDataFrame(path + star + odd, "a long, b long"), store)))
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(200)}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"), store)) == []


def brute_repeats(rows, least):
    """Places of words of a document that lie in a run of ``least`` words of an earlier one."""
    first, places = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        places[i] = set()
        for k in range(len(w) - least + 1):
            if first.setdefault(tuple(w[k : k + least]), i) != i:
                places[i] |= set(range(k, k + least))
    return places


def test_repeats_are_found_and_clean_texts_left_alone(spark, store):
    passage, other = prose(71, 60), prose(72, 120).split()
    changed = " ".join("changed" if k in (30, 60, 90) else w for k, w in enumerate(other))
    rows = [
        (1, prose(1, 80) + " " + passage + " " + prose(2, 30)),
        (2, passage.upper() + "\n" + prose(3, 50)),
        (3, prose(4, 200)),
        (4, " ".join(other)),
        (5, prose(5, 40) + " " + changed),
        (6, " ".join(passage.split()[:20]) + " " + prose(6, 100)),
        (7, passage + " " + passage),
    ]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    got = {(r["doc_id"], r["start"], r["end"], r["source_id"]) for r in substring.repeats(docs, store).collect()}
    assert (2, 0, 60, 1) in got
    assert {(r[0], r[1], r[2]) for r in got if r[0] == 5} == {(5, 40, 160)}
    assert {r[0] for r in got} == {2, 5, 7}
    assert max(r[2] for r in got if r[0] == 7) == 120


def test_repeats_cover_every_common_run(spark, store):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {i: set() for i, _ in rows}
    for r in substring.repeats(docs, store).collect():
        covered[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert all(places <= covered[i] for i, places in brute_repeats(rows, 50).items())


@pytest.mark.parametrize("copies", [40, 600])
def test_a_repeat_is_found_whose_parts_are_frequent(spark, store, copies):
    """On both sides of HOT occurrences of a part."""
    a, b = prose(81, 25), prose(82, 25)
    rows = [(k, f"{prose(1000 + k, 30)} {(a, b)[k % 2]} {prose(9000 + k, 30)}") for k in range(2 * copies)]
    rows += [(k, f"{prose(2000 + k, 30)} {a} {b} {prose(8000 + k, 30)}") for k in (5000, 6000)]
    rows += [(k, f"{prose(1000 + k, 30)} {(a, b)[k % 2]} {prose(9000 + k, 30)}") for k in range(10_000, 10_000 + 2 * copies)]
    covered = {i: set() for i, _ in rows}
    for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), store).collect():
        covered[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert covered == brute_repeats(rows, 45) and covered[6000] == set(range(30, 80))


def changed_every(words_, step, seed, kind="changed"):
    """Every ``step``-th word changed, from a place that the seed draws; or random ones, one in ``step``."""
    order = random.Random(seed)
    at = order.randrange(step)
    hit = [order.random() < 1 / step for _ in words_] if kind == "random" else [k % step == at for k in range(len(words_))]
    return [f"new{seed}x{k}" if hit[k] else w for k, w in enumerate(words_)]


@pytest.mark.parametrize("kind, least", [("changed", {12: 1, 10: 1, 8: 1, 7: 1, 6: 1, 5: 1}), ("random", {12: 0.99, 10: 0.99, 8: 0.98, 7: 0.97, 6: 0.97, 5: 0.95})])
def test_recall_of_fuzzy_repeats(spark, store, kind, least):
    """Passages of 60 words, of those that are still similar enough: how many are found, by distance of changes."""
    rows, due = [], {}
    for step in least:
        for k in range(100):
            a = prose(step * 1000 + k, 60, 4000).split()
            b = changed_every(a, step, step * 1000 + k, kind)
            i = 2 * (step * 1000 + k)
            rows += [(i, f"{prose(i, 30, 4000)} {' '.join(a)} {prose(i + 50_000, 30, 4000)}"), (i + 1, f"{prose(i + 100_000, 30, 4000)} {' '.join(b)} {prose(i + 150_000, 30, 4000)}")]
            if sum(x == y for x, y in zip(a, b)) >= 0.8 * 60:
                due.setdefault(step, set()).add(i + 1)
    got = {r["doc_id"] for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), store).collect()}
    recall = {step: len(ids & got) / len(ids) for step, ids in due.items()}
    print(kind, {s: (round(x, 3), len(due[s])) for s, x in recall.items()})
    assert all(recall[step] >= x for step, x in least.items())


def test_exact_repeats_meet_every_partner_whatever_is_around(spark, store):
    """A source that is neither the first nor the last document with any of its seeds, and one of which three times
    three words are put in, so that few words around a seed stand in the same places."""
    a, b = prose(71, 60, 4000).split(), prose(72, 36, 4000).split()
    changed = [f"new{k}" if k % 8 == 7 else w for k, w in enumerate(a)]
    parts = [" ".join(a[k : k + 7]) for k in range(0, 60, 8)]

    def decoy(seed):
        return " ".join(f"{prose(seed + k, 30, 4000)} {x}" for k, x in enumerate(parts))

    wide = [w for k, w in enumerate(b) for w in ([f"put{k}x{i}" for i in range(3)] if k in (9, 18, 27) else []) + [w]]
    texts = [decoy(2000), f"{prose(73, 30)} {' '.join(a)}", decoy(3000), f"{prose(74, 30)} {' '.join(changed)}",
             f"{prose(75, 30)} {' '.join(b)} {prose(76, 30)}", f"{prose(77, 30)} {' '.join(wide)} {prose(78, 30)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["source_id"]): r for r in substring.repeats(docs, store, exact=True).collect()}
    assert set(got) == {(3, 1), (5, 4)}
    assert got[3, 1]["end"] - got[3, 1]["start"] >= 53 and got[5, 4]["end"] - got[5, 4]["start"] == 45


def test_repeats_leave_no_partner_out(spark, store):
    """What a share of the seeds, the first partners and the words around would miss is found without being asked for."""
    a, b = prose(71, 60, 4000).split(), prose(72, 36, 4000).split()
    changed = [f"new{k}" if k % 8 == 7 else w for k, w in enumerate(a)]
    parts = [" ".join(a[k : k + 7]) for k in range(0, 60, 8)]
    decoys = [" ".join(f"{prose(seed + k, 30, 4000)} {x}" for k, x in enumerate(parts)) for seed in (2000, 3000)]
    wide = [w for k, w in enumerate(b) for w in ([f"put{k}x{i}" for i in range(3)] if k in (9, 18, 27) else []) + [w]]
    texts = [decoys[0], f"{prose(73, 30)} {' '.join(a)}", decoys[1], f"{prose(74, 30)} {' '.join(changed)}",
             f"{prose(75, 30)} {' '.join(b)} {prose(76, 30)}", f"{prose(77, 30)} {' '.join(wide)} {prose(78, 30)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["source_id"]) for r in substring.repeats(docs, store).collect()} == {(3, 1), (5, 4)}


def test_every_pair_is_met_in_whatever_portions(monkeypatch):
    """Pairs that are left out before alignment have no passage: the passages are those of all pairs, one by one."""
    order, texts = random.Random(3), []
    for k in range(24):
        text = prose(k, 30, 300).split() + ["the"] * order.randrange(12) + prose(100 + k, 20, 300).split() + ["of"] * order.choice((0, 5, 50))
        if k > 4:  # a passage of an earlier text, changed here and there
            old = texts[order.randrange(k)][:70]
            text += edited(old, order.choice(("put in", "left out", "changed", "mixed")), order.choice((3, 4, 5, 6, 9, 90)), k)
        texts.append(text + prose(200 + k, order.randrange(30), 300).split())
    coded = [substring.hashes([w.encode() for w in t]) for t in texts]
    due = []
    for i, a in enumerate(coded):
        for j, b in enumerate(coded[:i]):
            found = [x.tolist() for x in substring.diagonals(a, b)]
            for chain in substring.chains(*found) if found[0] else []:
                for x in substring.passages(a, b, [tuple(c[m] for c in found) for m in chain], 45, 0.8):
                    due.append((i, 0, x[0], x[1], j, x[2], x[3], x[4] / max(x[1] - x[0], x[3] - x[2])))
    rows = [x.astype("<u8").tobytes() for x in coded]
    theirs = substring.Block(np.arange(24), rows)
    batch = pa.RecordBatch.from_arrays([pa.array(range(24)), pa.array([0] * 24), pa.array(rows, pa.binary())], ["doc_id", "t", "w"])
    for at_once in (1 << 19, 200, 5):
        monkeypatch.setattr(substring, "AT_ONCE", at_once)
        got = [r for x in substring._against(iter([batch.slice(0, 15), batch.slice(15)]), theirs, 45, 0.8) for r in zip(*x.to_pydict().values())]
        assert sorted(got) == sorted(due) and len({r[0] for r in got}) > 7


def test_several_blocks_give_what_one_gives(spark, store, monkeypatch):
    texts = [f"{prose(k, 20)} {prose(500 + k % 7, 50)} {prose(900 + k, 20)}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    one = sorted(rows_of(substring.repeats(docs, store)))
    monkeypatch.setattr(substring, "BLOCK_WORDS", 1000)
    assert sorted(rows_of(substring.repeats(docs, store))) == one and len(one) == 53


def test_repeats_of_odd_rows(odd_docs, no_docs, store):
    got = substring.repeats(odd_docs, store).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(8, 7)}
    assert rows_of(substring.repeats(no_docs, store)) == []
    kept = substring.cut_repeats(odd_docs, store)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_cut_keeps_the_first_and_drops_what_is_empty(spark, store):
    a, b, c = prose(31, 70), prose(32, 50), prose(33, 20)
    docs = spark.createDataFrame([(1, f"{b}\n{a}", "x", 5), (2, f"{c} {a} {c}.", "y", 6), (3, a, "z", 7), (4, None, "n", 0)], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in substring.cut_repeats(docs, store).collect()}
    assert set(got) == {1, 2, 4} and got[1]["text"] == f"{b}\n{a}" and got[1]["n_chars"] == 5
    assert got[2]["text"] == f"{c} {c}." and got[2]["n_chars"] == len(got[2]["text"]) and got[2]["source"] == "y"


def test_chains_are_best():
    """The Fenwick tree finds what trying all predecessors finds."""
    order = np.random.default_rng(2)
    for _ in range(100):
        n = int(order.integers(1, 9))
        start, other, length = [order.integers(0, 60, n).tolist(), order.integers(0, 60, n).tolist(), order.integers(5, 20, n).tolist()]
        best = [0.0] * n
        for j in sorted(range(n), key=lambda i: start[i]):
            best[j] = length[j] + max([0.0, *[best[i] - substring.GAP_COST * (start[j] - start[i] - length[i] + other[j] - other[i] - length[i]) for i in range(n) if start[i] + length[i] <= start[j] and other[i] + length[i] <= other[j]]])
        chain = substring.chains(start, other, length)[0]
        score = sum(length[i] for i in chain) - sum(substring.GAP_COST * (start[j] - start[i] - length[i] + other[j] - other[i] - length[i]) for i, j in zip(chain, chain[1:], strict=False))
        assert score == pytest.approx(max(best))
        assert sorted(i for c in substring.chains(start, other, length) for i in c) == list(range(n))


def edited(words_, kind, step, seed):
    """A passage with a word put in, left out or replaced every ``step``, or these in turn."""
    out, turn = [], 0
    for k, w in enumerate(words_):
        if k % step == step - 1:
            how = ("put in", "left out", "changed")[turn % 3] if kind == "mixed" else kind
            turn += 1
            out += {"put in": [w, f"new{seed}x{k}"], "left out": [], "changed": [f"new{seed}x{k}"]}[how]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("kind", ["put in", "left out", "changed", "mixed"])
def test_recall_over_words_put_in_and_left_out(spark, store, kind):
    """Passages of 60 words between 80 unlike ones on each side: how many are found, nearly whole, by distance of edits."""
    rows, length = [], {}
    for step in (20, 12, 10, 8, 6):
        for k in range(40):
            i = 2 * (step * 1000 + k)
            a = prose(i, 60, 4000).split()
            b = edited(a, kind, step, i)
            length[i + 1] = (step, len(b))
            rows += [(i, f"{prose(i + 1, 80, 4000)} {' '.join(a)} {prose(i + 50_000, 80, 4000)}"), (i + 1, f"{prose(i + 100_000, 80, 4000)} {' '.join(b)} {prose(i + 150_000, 80, 4000)}")]
    found = {}
    for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), store).collect():
        step, n = length[r["doc_id"]]
        assert r["source_id"] == r["doc_id"] - 1 and r["start"] >= 76 and r["end"] <= 84 + n
        found.setdefault(step, []).append((r["end"] - r["start"]) / n)
    recall = {step: sum(x >= 0.85 for x in found.get(step, [])) / 40 for step in (20, 12, 10, 8, 6)}
    print(kind, recall)
    assert all(x >= 0.9 for x in recall.values())


def test_keys_of_texts_taken_together():
    """Word hashes of several texts in a row give the keys, marks and words around of each text alone: none lies across two."""
    texts = [prose(31, 70), None, "one two three", prose(32, 45), "", prose(33, 44), prose(34, 300)]
    h, owner = substring._hashed(list(enumerate(texts)))
    s, at = substring.seeds(h, owner)
    w = substring.around(h, owner, at)
    inside = np.flatnonzero(substring._inside(owner, 45))
    assert [int((owner[inside] == k).sum()) for k in range(len(texts))] == [max(0, len((x or "").split()) - 44) for x in texts]
    begins = 0
    for k, text in enumerate(texts):
        mine, hashed = owner[at] == k, substring.hashes((text or "").lower().encode().split())
        alone, places = substring.seeds(hashed, np.zeros(len(hashed), np.int64))
        assert s[mine].tolist() == alone.tolist() and (at[mine] - begins).tolist() == places.tolist()
        code = [0] * 12 + [int(x) % 15 + 1 for x in hashed] + [0] * 12
        assert w[mine].tolist() == [[code[p + i] << 4 | code[p + 16 + i] for i in range(12)] for p in places]
        assert substring._marks(h, 45)[inside[owner[inside] == k]].tolist() == substring._marks(hashed, 45).tolist()
        begins += len(hashed)


def test_widest_passage_with_as_few_equal_words_as_allowed():
    """36 of 45 words are enough, 35 are not."""
    a = np.arange(100, 145, dtype=np.uint16)
    for unlike, found in ((9, 1), (10, 0)):
        b = a.copy()
        b[[3 + 4 * k for k in range(unlike)]] = 1
        assert len(substring.widest(a, b, (0, 0, 3), 45, 0.8)) == found
