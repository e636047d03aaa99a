"""Operator 12: how far the word use of a language's sources lies apart.

Identical texts of a language are collapsed first: hashes are counted by source, one copy of each text is
kept, and it is tokenised once, its counts taken as often as each source holds it. Copies meet as partial sums where they are
read, so a text that is a third of all rows is one row a task afterwards.

Source pairs are evaluated sparsely. For sources a and b, terms that neither holds all have the same
value, terms that only one holds are summed by that one's distinct counts, and only terms both hold are
compared one by one: blocks of whole terms meet in numpy and give a sum for each pair of sources, never a row a term and pair.
All arithmetic is in whole numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import Store

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TERM_RANKS = 200
ENTRIES = 1 << 18  # (term, source) entries in a block, about
HELD = 1 << 18  # counted terms a task holds before it hands them on
HANDED = 1 << 14  # terms in a batch
HELD_BY = "array<struct<source:string,n:long,docs:long>>"
CELLS = 1 << 21  # of a block's dense part
SALTS = 16  # shares of a language, where its rows meet its groups

#: Bytes of a term keep their value, A-Z in lower case; all others end it. UTF-8 bytes of other characters are above 0x7F.
_KEPT = bytes(b if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z in lower case."""
    return text.translate(_KEPT).split()


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def share(count: Column, of: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (of + kept)), exact for any 64-bit counts."""
    return (F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (of + kept).cast("decimal(20,0)")) + 1).cast("long")


def collapsed(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """``lang, text, held`` of every distinct text, ``held`` being its ``(source, n)``; and ``lang, source, n`` of every group."""
    # Two hashes of the text tell texts apart: 128 bits.
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    read = read.select("lang", "source", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g"))
    counted = store.keep(read.groupBy("lang", "source", "h", "g").agg(F.count("*").alias("n")), "copies")
    held = counted.groupBy("lang", "h", "g").agg(F.collect_list(F.struct("source", "n")).alias("held"))
    texts = read.groupBy("lang", "h", "g").agg(F.min("text").alias("text"))
    return texts.join(held, ["lang", "h", "g"]).select("lang", "text", "held"), counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))


def counted_terms(classes: DataFrame) -> DataFrame:
    """``lang, term, source, n, docs``: occurrences, and documents that hold the term, weighted by copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            lists = batch.column(2)
            for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                found = terms(text.as_py())
                once, weighted = set(found), None
                for x in lists[i].as_py():
                    key, n = (lang, x["source"]), x["n"]
                    if key not in counts:
                        counts[key], docs[key] = Counter(), Counter()
                    c, d = counts[key], docs[key]
                    before = len(c)
                    if n == 1:
                        c.update(found)
                        d.update(once)
                    else:
                        weighted = weighted or Counter(found)
                        for t, k in weighted.items():
                            c[t] += n * k
                            d[t] += n
                    held += len(c) - before
                    if held > HELD:
                        yield from _handed(counts, docs)
                        counts, docs, held = {}, {}, 0
        yield from _handed(counts, docs)

    rows = classes.select("lang", F.col("text").cast("binary"), "held").mapInArrow(run, f"lang string, term binary, held {HELD_BY}")
    # A term's rows, one from each task, meet once; the sums and what follows by term need no further exchange.
    each = rows.repartition("lang", "term").select("lang", "term", F.explode("held").alias("x")).select("lang", "term", "x.source", "x.n", "x.docs")
    return each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _handed(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    """For each language a row a term, with what each source holds of it."""
    for lang in {of for of, _ in counts}:
        flat, source, n, d = [], [], [], []
        names = [s for of, s in counts if of == lang]
        for k, name in enumerate(names):
            c, of = counts[lang, name], docs[lang, name]
            flat += c
            source.append(np.full(len(c), k))
            n.append(np.fromiter(c.values(), np.int64, len(c)))
            d.append(np.fromiter((of[t] for t in c), np.int64, len(c)))
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        at = np.asarray(coded.indices)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(coded.dictionary) + 1))
        columns = [pa.array(names, pa.string()).take(pa.array(np.concatenate(source)[order])), pa.array(np.concatenate(n)[order]), pa.array(np.concatenate(d)[order])]
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["source", "n", "docs"]))
        whole = pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), coded.dictionary, held], ["lang", "term", "held"])
        for k in range(0, len(held), HANDED):
            yield whole.slice(k, HANDED)


def shared_sums(size: int, t: np.ndarray, s: np.ndarray, p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sources a, b of a block: the sum, over terms both hold, of what comparing them adds to the sparse rest.

    ``t`` numbers the terms, ``s`` the sources (``size`` of them); ``p`` is an entry's share, ``z`` that of a term its source does not hold."""
    a, b, total = [], [], []
    base = np.zeros(size, np.int64)
    base[s] = z
    by_source = np.argsort(s, kind="stable")
    step = max(1, CELLS // max(size, 1))
    ends = np.searchsorted(s[by_source], np.arange(size + 1))
    most = int(t.max()) + 1 if len(t) else 0
    sums: dict[int, np.ndarray] = {}
    for low in range(0, most, step):
        here = (t >= low) & (t < low + step)
        dense = np.zeros((min(step, most - low), size), np.int64)
        dense[t[here] - low, s[here]] = p[here]
        for k in range(size):
            own = by_source[ends[k] : ends[k + 1]]
            own = own[here[own]]
            if not len(own):
                continue
            q = dense[t[own] - low]
            at = q > 0
            x, zq = p[own][:, None], base[None, :]
            q = np.where(at, q, 1)
            value = (x - q) ** 2 // q - (x - zq) ** 2 // zq - (base[k] - q) ** 2 // q + ((base[k] - base) ** 2 // base)[None, :]
            sums[k] = sums.get(k, 0) + np.where(at, value, 0).sum(axis=0)
    for k, row in sums.items():
        some = np.flatnonzero(row)
        some = some[some != k]
        a.append(np.full(len(some), k)), b.append(some), total.append(row[some])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, total))


def both_hold(kept: DataFrame) -> DataFrame:
    """``lang, source, other, value``: the part of a pair's value that needs terms both hold; from ``lang, source, term, p, z, most``.

    ``most`` bounds the entries of the language. No step deals rows by language alone."""
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("most") / ENTRIES).cast("long")))
    blocks = dealt.groupBy("lang", "block").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "source", "p", "z")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e = batch.column(1).slice(i, 1).flatten()
                names = e.field("source").dictionary_encode()
                _, t = np.unique(np.asarray(e.field("t")), return_inverse=True)
                s = np.asarray(names.indices).astype(np.int64)
                a, b, total = shared_sums(len(names.dictionary), t, s, np.asarray(e.field("p")), np.asarray(e.field("z")))
                lang = pa.array([batch.column(0)[i].as_py()] * len(a), pa.string())
                yield pa.RecordBatch.from_arrays([lang, names.dictionary.take(pa.array(a)), names.dictionary.take(pa.array(b)), pa.array(total, pa.int64())], ["lang", "source", "other", "value"])

    return blocks.select("lang", "e").mapInArrow(run, "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, store: Store, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    Part ``pair``: every other source of the language with the divergence of the group from it; part ``term``: the ``ranks`` terms the group
    uses most above its language. Null text, lang and source are the empty text. Groups without terms have pairs too; in a language without
    kept terms all pairs are 0. Repeated rows are documents of their own, texts are read whole, ties go to the lower item in UTF-8. An
    empty table gives no rows. Other columns are dropped. Terms are told apart in blocks by 64 bits, texts by 128."""
    classes, groups = collapsed(docs, store)
    of_term = Window.partitionBy("lang", "term")  # a row a source at most
    found = counted_terms(classes).select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n", F.sum("n").over(of_term).alias("all"), F.sum("docs").over(of_term).alias("docs"),
        (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("first"),
    )
    held = store.keep(found.where(F.col("docs") >= least).drop("docs"), "terms")
    langs = held.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("of_lang"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("of"))
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = groups.select("lang", "source", "sources", F.coalesce("kept", zero).alias("kept"), F.coalesce("of_lang", zero).alias("of_lang"), F.coalesce("of", zero).alias("of"))
    z = F.when(F.col("kept") > 0, share(zero, F.col("of"), F.col("kept")))
    groups = store.keep(groups.withColumn("z", z), "groups")  # a row a group

    kept = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("of"), F.col("kept")).alias("p"), "z", share(F.col("all"), F.col("of_lang"), F.col("kept")).alias("q"),
        (F.col("kept") * F.col("sources")).alias("most"),
    )
    kept = store.keep(kept, "shares")

    by_value = [F.desc("value"), F.asc("item")]
    ranked = Window.partitionBy("lang", "source").orderBy(*by_value)
    of_terms = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    of_terms = of_terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= ranks)

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("zo"), salts)

    def meet(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(other, ["lang", "salt"]).where("source <> other")

    pairs = meet(groups.select("lang", "source", "z", "kept"), "source")  # the rows of the result
    none = divergence(F.col("z"), F.col("zo"))
    same = store.keep(kept.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("k")), "by-share")  # terms of equal counts
    across = meet(same, "source", "p")
    over = across.groupBy("lang", "source", "other").agg(F.sum(F.col("k") * (divergence(F.col("p"), F.col("zo")) - none)).alias("value"))
    under = across.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("other")).agg(
        F.sum(F.col("k") * (divergence(F.col("zo"), F.col("p")) - divergence(F.col("zo"), F.col("z")))).alias("value")
    )
    rest = pairs.select("lang", "source", "other", F.coalesce(F.col("kept") * none, zero).alias("value"))
    summed = rest.unionByName(over).unionByName(under).unionByName(both_hold(kept)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    of_pairs = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(ranked))
    return of_pairs.unionByName(of_terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
