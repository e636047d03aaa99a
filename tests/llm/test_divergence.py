"""Operator 12 against the definition in plain Python numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, prose, rows_of

from quayside.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, doc_id long"


def plain(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        frequency, groups = Counter(), defaultdict(Counter)
        for of, source, terms in docs:
            if of == lang:
                frequency.update(set(terms))
                groups[source].update(terms)
        kept = [t for t, n in frequency.items() if n >= least]

        def shares(count):
            of = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (of + len(kept)) for t in kept}

        q, p = shares(sum(groups.values(), Counter())), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            above = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", above, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_for_test():
    rows = []
    for i in range(120):
        lang, source = ("en", "de", None)[i % 3], ("a", "b", "c", None, "hot", "hot", "hot")[i % 7]
        rows.append((prose(i, 5 + i % 40, 12).replace("x", " É").upper() if i % 2 else prose(i, 30, 9), lang, source, i))
    copies = [("One text that is a third of all rows", "en", ("a", "hot", "b")[i % 3], 500 + i) for i in range(60)]
    odd = [(None, None, None, None), ("", "en", "empty", 1), ("1 2 3 ...", "en", "digits", 2), ("日本 日本 ﬁ À", "ja", "x", 3), ("日本", "ja", "y", 4), ("日本 b", "ja", "z", 5)]
    odd += [("lonely", "xx", "p", 6), ("words", "xx", "q", 7), (prose(3, 20_000, 30), "en", "long", 8), ("a" * 60_000, "en", "long", 9)]
    return rows + copies + odd + rows[:10]


@pytest.mark.parametrize("held", [divergence.HELD, 5])
def test_equals_the_definition(spark, store, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "ENTRIES", 64)
    monkeypatch.setattr(divergence, "CELLS", 32)
    rows = rows_for_test()
    got = divergence.audit(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5), store)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(rows_of(got)) == plain(rows)


def test_only_the_first_terms_are_told(spark, store):
    rows = rows_for_test()
    assert sorted(rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), store, least=1, ranks=4))) == plain(rows, 1, 4)


def test_empty_table(spark, store):
    assert rows_of(divergence.audit(spark.createDataFrame([], SCHEMA), store)) == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, of, kept = 9_000_000_000_000_001, 9_000_000_000_000_123, 77
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(of), F.lit(kept)).alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * (n + 1) // (of + kept)


def test_sums_of_shared_terms():
    order = np.random.default_rng(1)
    t, s = np.nonzero(order.random((40, 6)) < 0.4)
    z = order.integers(1, 50, 6)
    p = order.integers(50, 10**9, len(t))
    got = {(a, b): v for a, b, v in zip(*divergence.shared_sums(6, t, s, p, z[s]), strict=True)}
    of = {(a, b): int(v) for a, b, v in zip(t, s, p, strict=True)}
    f = lambda x, y: (int(x) - int(y)) ** 2 // int(y)
    for a in range(6):
        for b in range(6):
            both = [k for k in range(40) if (k, a) in of and (k, b) in of]
            want = sum(f(of[k, a], of[k, b]) - f(of[k, a], z[b]) - f(z[a], of[k, b]) + f(z[a], z[b]) for k in both)
            assert a == b or got.get((a, b), 0) == want
