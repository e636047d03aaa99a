"""Operators 2, 3, 5 and 8: held-out accuracy, brute force, and odd rows."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from quayside.llm import lm, quality, toxicity, urls
from quayside.llm.common import fold, words

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(doc_id, n):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % n == 1


def test_quality_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels, fold("doc_id", 3) != 1)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    truth = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if held(r["doc_id"], 3)]
    assert sum(a == b for a, b in truth) / len(truth) >= 0.97


def test_quality_of_odd_rows(spark, odd_docs, no_docs, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    got = quality.score_documents(odd_docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == odd_docs.count()
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert rows_of(quality.score_documents(no_docs, model)) == []
    nothing = quality.train(no_docs, labels)
    assert {r["score"] for r in quality.score_documents(odd_docs, nothing).collect()} == {0.5}


def plain_quality(text, model):
    """The score of a text one n-gram at a time."""
    raw = (text or "").encode("utf-8", "replace")
    kept = quality.DIMENSIONS - quality.PATTERNS
    index = {((a | b << 8 | c << 16) * 2654435761 % 2**32 >> 16) % kept for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)}
    found = raw.split()
    for step in (1, 2, 3):
        if len(found) > step:
            same = sum(found[k] == found[k + step] for k in range(len(found) - step)) / (len(found) - step)
            index.add(kept + 16 * step + min(15, int(16 * same)))
    length = math.sqrt(1 + sum(float(model.ratios[i]) ** 2 for i in index))
    margin = (math.fsum(float(model.weights[i]) for i in index) + model.intercept) / length
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * margin + model.shift))))


def test_quality_of_a_whole_table_one_gram_at_a_time(spark, labelled, odd_docs):
    docs, labels = labelled
    model = quality.train(docs, labels, fold("doc_id", 3) != 1)
    for table in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd_docs):
        got = sorted((str(r["doc_id"]), r["score"]) for r in quality.score_documents(table, model).collect())
        want = sorted((str(r["doc_id"]), plain_quality(r["text"], model)) for r in table.collect())
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)


def test_dual_descent_solves_the_hinge_loss():
    """No direction from the fitted weights lowers the primal objective."""
    order = np.random.default_rng(1)
    rows = [np.sort(order.choice(200, 20, replace=False)) + 100 * (k % 2) for k in range(60)]
    good = np.array([k % 2 == 0 for k in range(60)])
    ratios = quality.log_count_ratios(rows, good)
    model = quality.fit(rows, good, rounds=500)
    used = np.flatnonzero(ratios)
    w = np.zeros(quality.DIMENSIONS)
    w[used] = model.weights[used] / ratios[used]
    x = np.zeros((60, quality.DIMENSIONS + 1))
    for k, index in enumerate(rows):
        x[k, index], x[k, -1] = ratios[index], 1
        x[k] /= np.linalg.norm(x[k])
    v = np.append(w, model.intercept)
    y = np.where(good, 1, -1)

    def objective(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    best = objective(v)
    for _ in range(50):
        d = order.normal(size=60) @ x
        assert objective(v + 1e-3 * d / np.linalg.norm(d)) >= best - 2e-4


def test_toxicity_on_held_out_documents(spark, labelled, store):
    docs, labels = labelled
    model = toxicity.train(docs, labels, store, fold("doc_id", 3) != 1)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    truth = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if held(r["doc_id"], 3)]
    # The test table is small (some 30 toxic documents to learn from); a few hold no marked word at all.
    clean = [r["toxic"] for y, r in truth if not y]
    toxic = [r["toxic"] for y, r in truth if y]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.6 * len(toxic)
    means = [np.mean([r["severity"] for y, r in truth if y == k]) for k in (0, 1)]
    assert means[1] > means[0] + 0.5


def plain_toxicity(text, model):
    """Expected grade and the chance of grade 1 or more, one window at a time."""
    raw = "".join(c if not c.isascii() or c.isalnum() else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    raw = b" " + " ".join(raw.split(" ")).encode("utf-8", "replace") + b" "
    raw = b" " + b" ".join(raw.split()) + b" " if raw.split() else b""
    counts = {}
    for width in toxicity.WIDTHS:
        for k in range(len(raw) - width + 1):
            counts[raw[k : k + width]] = counts.get(raw[k : k + width], 0) + 1
    total = 0.0
    for packed, weight in zip(model.windows.tolist(), model.weights.tolist(), strict=True):
        width = packed >> 56
        total += weight * math.log1p(counts.get((packed & (1 << 8 * width) - 1).to_bytes(width, "big"), 0))
    reached = [1 / (1 + math.exp(-max(-30.0, min(30.0, total - t)))) for t in model.thresholds.tolist()]
    return sum(reached), reached[0]


def test_toxicity_of_a_whole_table_one_window_at_a_time(spark, labelled, odd_docs, store):
    docs, labels = labelled
    model = toxicity.train(docs, labels, store, fold("doc_id", 3) != 1)
    assert len(model.windows) > 10
    for table in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd_docs):
        got = sorted((str(r["doc_id"]), r["severity"], r["chance"]) for r in toxicity.score_documents(table, model).collect())
        want = sorted((str(r["doc_id"]), *plain_toxicity(r["text"], model)) for r in table.collect())
        assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1:] for x in got], [x[1:] for x in want], rtol=1e-9)


def test_ordinal_regression_recovers_grades():
    order = np.random.default_rng(3)
    n = order.integers(0, 12, 400)
    grades = np.minimum(3, n // 3)
    rows = [(np.array([0]) if k else np.zeros(0, int), np.array([k]) if k else np.zeros(0, int)) for k in n]
    w, thresholds = toxicity.fit_ordinal(rows, grades, 1, penalty=1e-6, steps=1500)
    reached = toxicity._logistic(np.log1p(n)[:, None] * w[0] - thresholds)
    assert (np.diff(thresholds) > 0).all()
    assert ((reached >= 0.5).sum(axis=1) == grades).mean() > 0.95
    assert all(np.diff(reached.sum(axis=1)[np.argsort(n, kind="stable")]) >= -1e-12)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, labelled, store):
    docs, labels = labelled
    nothing = toxicity.train(no_docs, labels, store)
    got = toxicity.score_documents(odd_docs, nothing)
    assert got.count() == odd_docs.count() and not any(r["toxic"] for r in got.collect())
    assert rows_of(toxicity.score_documents(no_docs, nothing)) == []
    insults = spark.createDataFrame([(k, f"plain words {k} here nitwit fool" if k % 2 else f"plain words {k} here") for k in range(40)], "doc_id long, text string")
    marks = insults.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(insults, marks, store)
    assert [r["toxic"] for r in toxicity.score_documents(insults, model).orderBy("doc_id").collect()] == [bool(k % 2) for k in range(40)]
    long = spark.createDataFrame([(1, "plain words " * 200_000), (2, None)], "doc_id long, text string")
    assert not any(r["toxic"] for r in toxicity.score_documents(long, model).collect())


def test_windows_of_a_long_text_equal_those_of_its_parts(monkeypatch):
    text = " ".join(f"word{k}" for k in range(500))
    whole = np.sort(np.concatenate(list(toxicity.windows(text))))
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert (np.sort(np.concatenate(list(toxicity.windows(text)))) == whole).all()


URLS = [
    ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://B.Example.NET/fr/1?x=/en/#t", "b.example.net", "/fr/1", "net/", "block"),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("x://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"),
    ("x://net", "net", "", None, None),
    ("x://net?/", "net", "", None, None),
    ("x://net/", "net", "/", "net/", "block"),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://ÄÖ.Example.org/fr/x", "ÄÖ.example.org", "/fr/x", "org/fr/", "allow"),
]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = urls.judge(pages, urls.local_table(spark, urls.labelled_urls())).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [u[1:4] for u in URLS]
    for r, u in zip(got, URLS, strict=True):
        assert r["verdict"] == (u[4] or ("block" if r["probability"] >= 0.5 else "allow"))


def test_url_model_equals_a_plain_one_and_tells_held_out_hosts(spark):
    table = urls.labelled_urls()
    weights = urls.train(urls.local_table(spark, table))
    pages = [("https://www.casino-bets.example.com/en/1", "block"), ("https://cheap-spam.example.org/de/7.html", "block"), ("https://harbour.example.com/en/1", "allow"), ("https://m.thwhother.example.org/es/1#top", "allow")]
    known = spark.createDataFrame([(i, u) for i, (u, _) in enumerate([*table, *pages])], "page_id long, url string")
    host, path = urls.host_and_path(F.col("url"))
    rows = known.select("page_id", urls.ngrams(host, path).alias("g"), urls.block_probability(host, path, weights).alias("p")).orderBy("page_id").collect()
    grams = [r["g"] for r in rows]
    y = np.array([v == "block" for _, v in table], float)
    n = len(table)
    x = np.zeros((len(rows), urls.DIMENSIONS + 1))
    for k, g in enumerate(grams):
        x[k, g] = 1 / math.sqrt(len(g))
        x[k, -1] = 1
    alpha, gram = np.zeros(n), x[:n] @ x[:n].T
    for _ in range(urls.STEPS):
        alpha = alpha * (1 - urls.RATE * urls.PENALTY) + urls.RATE * (y - 1 / (1 + np.exp(-gram @ alpha)))
    p = 1 / (1 + np.exp(-x @ (x[:n].T @ alpha)))
    assert np.allclose(p, [r["p"] for r in rows], atol=1e-9)
    assert [("block" if r["p"] >= 0.5 else "allow") for r in rows[n:]] == [v for _, v in pages]


def test_urls_of_odd_tables(spark):
    none = urls.local_table(spark, [])
    assert set(urls.train(none)) == {0.0}
    pages = spark.createDataFrame([], "page_id long, url string")
    assert rows_of(urls.judge(pages, urls.local_table(spark, urls.labelled_urls()))) == []
    odd = spark.createDataFrame([(None, "http://a/" + "b" * 50_000), (1, "http://a/x"), (1, "http://a/x")], "page_id long, url string")
    assert urls.judge(odd, none, ()).count() == 3


def brute_marginal(lattice, text):
    """Log of the sum over every segmentation, one by one."""
    if not text:
        return [0.0]
    out = []
    for k in range(1, len(text) + 1):
        weights = []
        entry = lattice.table.get(text[:k])
        if entry is not None:
            weights.append(entry[0])
        if k == 1:
            weights.append(sum(lattice.bytes[x] for x in text[0].encode()))
        for w in weights:
            out += [w + rest for rest in brute_marginal(lattice, text[k:])]
    return out


def test_lattice_sums_over_all_segmentations():
    pieces, logs = lm.vocabulary(PIECES)
    assert math.isclose(np.exp(logs).sum(), 1)
    lattice = lm.Lattice(pieces, logs)
    for word in ("a", "the", "other", "nation", "é", "日本", "x日", "3.14"):
        paths = brute_marginal(lattice, lm.MARK + word)
        assert math.isclose(lattice.marginals([word.encode()])[0], math.log(sum(map(math.exp, paths))), rel_tol=1e-12)
        counts = np.zeros(len(logs))
        lattice.expect([word.encode()], np.array([2.0]), counts)
        spelled = sum(n * (len(pieces[k]) if k < len(pieces) else 0) for k, n in enumerate(counts))
        total = len(lm.MARK + word) * 2
        assert counts.sum() > 0 and spelled <= total + 1e-9
    assert np.isfinite(lattice.marginals([b"a" * 50_000, b"\xff\xfe".decode("latin-1").encode()])).all()


def test_words_together_give_what_they_give_alone(monkeypatch):
    pieces, logs = lm.vocabulary(PIECES)
    lattice = lm.Lattice(pieces, logs)
    found = [w.encode() for w in "the other nation é 日本 x日 internationalisation a b ab 3.14 ÿ the -- don't".split()]
    times = np.arange(1.0, len(found) + 1)
    together, alone = np.zeros(len(logs)), np.zeros(len(logs))
    marginals = lattice.marginals(found)
    lattice.expect(found, times, together)
    monkeypatch.setattr(lm, "SHORT", 0)
    assert np.allclose(marginals, lattice.marginals(found), rtol=1e-12)
    lattice.expect(found, times, alone)
    assert np.allclose(together, alone, rtol=1e-9, atol=1e-15)


def check_scores(docs, got, path):
    """Against counting in plain Python and the lattice word by word."""
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    count = {}
    ends = 0
    for i, w in rows:
        if not held(i, 5):
            ends += 1
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    pieces, logs = lm.vocabulary(path)
    lattice, expected = lm.Lattice(pieces, logs), np.zeros(len(logs))
    lattice.expect(list(count), np.array(list(count.values()), float), expected)
    expected[-1] = ends
    fitted = expected + lm.PRIOR * len(logs) * np.exp(logs)
    logs = np.log(fitted / fitted.sum())
    lattice = lm.Lattice(pieces, logs)
    want = []
    for i, w in rows:
        base = sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        score = (lattice.marginals(w).sum() + logs[-1]) / math.log(10)
        want.append((i, held(i, 5), len(w) + 1, sum(x in count for x in w) + (ends > 0), n, base, score))
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted(map(tuple, got.collect()), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_scores_of_a_table(spark, store, monkeypatch):
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    docs = spark.createDataFrame(few.collect(), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "BLOCK", 5_000)
    check_scores(docs, lm.score_documents(docs, fold("doc_id", 5) == 1, PIECES, store), PIECES)


def test_scores_where_frequent_words_are_counted_apart(spark, store, monkeypatch):
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    docs = spark.createDataFrame(few.collect(), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "HOT_BLOCKS", 3)
    monkeypatch.setattr(lm, "HOT_SAMPLE", 1)
    monkeypatch.setattr(lm, "MOST_HOT", 40)
    counted = spark.createDataFrame([(b"a", 1 << 28, 2), (b"a", 2 << 28, 3), (b"a", 3 << 28, 0), (b"a", 4 << 28, 5), (b"b", 1, 7)], "word binary, place long, n_train long")
    assert [(bytes(r["word"]), r["hot_c"]) for r in lm._hot_words(counted, store).collect()] == [(b"a", 10)]
    seen = []
    find = lm._hot_words
    monkeypatch.setattr(lm, "_hot_words", lambda *x: seen.append(find(*x)) or seen[-1])
    monkeypatch.setattr(lm, "HOT_BLOCKS", 1)
    check_scores(docs, lm.score_documents(docs, fold("doc_id", 5) == 1, PIECES, store), PIECES)
    assert 0 < seen[0].count() <= 40


def test_scores_of_odd_rows(odd_docs, no_docs, store):
    check_scores(odd_docs, lm.score_documents(odd_docs, fold("doc_id", 5) == 1, PIECES, store), PIECES)
    assert rows_of(lm.score_documents(no_docs, fold("doc_id", 5) == 1, PIECES, store)) == []
