import numpy as np
from pyspark.sql import functions as F

from quayside.operators import retrieval as r
from quayside.operators import similarity as s
from quayside.operators.ranking import bucketed, percentiles, splitters, with_rank


def vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim))
    data[n // 3: 2 * n // 3] = data[0]  # a third of the table are copies
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(6), np.float32(data).astype(float)


def brute(data, i, k):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round(unit @ unit[i], 9)
    return sorted(range(len(data)), key=lambda j: (-scores[j], j))[:k]


def test_vector_search_is_exact_with_copies_and_blocks(spark):
    df, data = vectors(spark)
    queries = df.filter("id < 9").withColumnRenamed("id", "query")
    for block in (100, 4):
        rows = s.vector_search(queries, df, "id", 7, block=block).collect()
        for i in range(9):
            assert [r["id"] for r in sorted((r for r in rows if r["query"] == i), key=lambda r: r["rank"])] == brute(data, i, 7)


def test_a_hundred_thousand_queries_are_one_job(spark, monkeypatch):
    """Nothing is written between, and the plan reads the vectors once."""
    df, data = vectors(spark, 40)
    queries = spark.range(100_000).select(F.col("id").alias("query"), (F.col("id") % 40).alias("id")).join(df, "id").drop("id")
    monkeypatch.setattr(s, "shared_dir", None)
    rows = s.vector_search(queries, df, "id", 1).where("rank = 1").groupBy(F.col("query") % 40, "id").count().collect()
    first = {i: brute(data, i, 1)[0] for i in range(40)}
    assert {(r[0], r["id"]) for r in rows} == set(first.items()) and all(r["count"] == 2500 for r in rows)


def test_approximate_search(spark):
    df, data = vectors(spark)
    queries = df.filter("id < 9").withColumnRenamed("id", "query")
    exact = {(r["query"], r["id"]) for r in s.vector_search(queries, df, "id", 5).collect()}
    every = {(r["query"], r["id"]) for r in s.approx_vector_search(queries, df, "id", 5, cells=6, probes=6).collect()}
    some = {(r["query"], r["id"]) for r in s.approx_vector_search(queries, df, "id", 5, cells=6, probes=3).collect()}
    assert every == exact and len(some & exact) / len(exact) > 0.6


def test_approximate_search_reads_enough_cells(spark):
    """Vectors without groups, for which a quarter of the cells holds far less than nine tenths of the neighbours."""
    order = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(order.normal(size=(900, 24)))], "id bigint, embedding array<double>")
    queries = df.filter("id < 60").withColumnRenamed("id", "query")
    exact = {(r["query"], r["id"]) for r in s.vector_search(queries, df, "id").collect()}
    found = {(r["query"], r["id"]) for r in s.approx_vector_search(queries, df, "id").collect()}
    assert len(found & exact) / len(exact) >= 0.9


def knowledge(spark):
    texts = spark.createDataFrame([(1, "Return items within thirty days of delivery", "Returns"), (2, "Standard shipping costs sixty", "Shipping"),
                                   (3, "Employees get annual leave", "Leave")], "chunk_id bigint, content string, section string")
    emb = spark.createDataFrame([(1, [1.0, 0.0, 0.1]), (2, [0.0, 1.0, 0.1]), (3, [0.0, 0.0, 1.0])], "chunk_id bigint, embedding array<double>")
    return texts, emb


def ask(spark, *variants):
    rows = [(1, i, text, vector) for i, (text, vector) in enumerate(variants)]
    return spark.createDataFrame(rows, "query_id bigint, variant int, text string, embedding array<double>")


TEXT = ("section", "content")


def test_hybrid_search_orders_filters_and_fuses(spark):
    texts, emb = knowledge(spark)
    text = F.concat_ws(" ", *TEXT)
    q = ask(spark, ("return items policy", [1.0, 0.0, 0.0]))
    rows = r.hybrid_search(q, texts, emb, text, 3, minimum=0.2).orderBy("rank").collect()
    assert rows[0]["chunk_id"] == 1 and rows[0]["score"] == 1.0
    assert r.hybrid_search(q, texts, emb, text, 3, minimum=2.0).count() == 0
    only = spark.createDataFrame([(2,)], "chunk_id bigint")
    assert [x["chunk_id"] for x in r.hybrid_search(q, texts, emb, text, 3, only, minimum=-1.0).collect()] == [2]
    both = ask(spark, ("return items policy", [1.0, 0.0, 0.0]), ("shipping costs", [0.0, 1.0, 0.0]))
    assert {x["chunk_id"] for x in r.hybrid_search(both, texts, emb, text, 3, minimum=0.2).collect()} >= {1, 2}
    assert r.document_relevance(q, texts, emb, text, minimum=2.0).first()["relevance"] == 0.0


def test_document_filter_takes_ids(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "chunk_id int, document_id int")
    docs = spark.createDataFrame([(10, "a", "a.md", "indexed"), (20, "b", "b.md", "failed"), (30, "c", "c.md", "indexed")],
                                 "document_id int, title string, filename string, status string")
    assert [x["chunk_id"] for x in r.searchable(chunks, docs, [20, 30]).collect()] == [3]


def test_keyword_search_without_broadcast(spark):
    texts, _ = knowledge(spark)
    q = ask(spark, ("return items shipping", None))
    postings = r.build_postings(texts, "chunk_id", F.concat_ws(" ", *TEXT))
    want = r.keyword_search(q, postings).collect()
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert sorted(r.keyword_search(q, postings).collect()) == sorted(want) and want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_any_number_of_variants_and_ids_of_any_kind(spark):
    emb = spark.createDataFrame([("a-1", [1.0, 0.0]), ("b-2", [0.0, 1.0]), ("odd", [1.0]), ("none", None)], "chunk_id string, embedding array<double>")
    rows = [("q", 0, [1.0, 0.0]), ("q", 64, [0.0, 1.0]), ("p", 0, [0.6, 0.8]), ("p", 1, [1.0, 2.0, 3.0]), (None, 5, [1.0, 0.0])]
    queries = spark.createDataFrame(rows, "query_id string, variant int, embedding array<double>")
    got = {(x["query_id"], x["variant"], x["rank"]): x["chunk_id"] for x in r.vector_lists(queries, emb, 2).collect()}
    assert got == {("q", 0, 1): "a-1", ("q", 0, 2): "b-2", ("q", 64, 1): "b-2", ("q", 64, 2): "a-1",
                   ("p", 0, 1): "b-2", ("p", 0, 2): "a-1", (None, 5, 1): "a-1", (None, 5, 2): "b-2"}


def test_a_blank_variant_does_not_lower_scores(spark):
    texts, emb = knowledge(spark)
    text = F.concat_ws(" ", *TEXT)
    one = ask(spark, ("return items policy", [1.0, 0.0, 0.0]))
    two = ask(spark, ("return items policy", [1.0, 0.0, 0.0]), ("  ", None))
    assert r.hybrid_search(one, texts, emb, text, 3).collect() == r.hybrid_search(two, texts, emb, text, 3).collect()


def test_ranks_keep_nulls_and_nan(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0), ("a", None), ("a", nan), ("a", inf), ("a", -inf), (None, 2.0), (None, None), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = sorted((str(x["k"]), str(x["v"]), x["rank"]) for x in with_rank(df, "v", by=["k"]).collect())
    assert got == sorted([("a", "nan", 1), ("a", "inf", 2), ("a", "1.0", 3), ("a", "-inf", 4), ("a", "None", 5), ("None", "2.0", 1), ("None", "2.0", 1), ("None", "None", 3)])
    assert with_rank(df, "v").count() == len(rows)


def test_rerank_drops_low_grades(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id int, chunk_id int, rank int")
    grades = spark.createDataFrame([(1, 5, 5), (1, 6, 9)], "query_id int, chunk_id int, grade int")
    assert [x["chunk_id"] for x in r.rerank(found, grades).orderBy("position").collect()] == [6, 5]


def test_percentiles_and_ranks_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(400, 7.25), rng.lognormal(3, 2, 500), -rng.lognormal(1, 1, 100), np.zeros(50)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    row = percentiles(df, "v", {"a": ("continuous", 0.5), "b": ("continuous", 0.95), "c": ("nearest", 0.95), "d": ("nearest", 0.0)}).first()
    assert np.isclose(row["a"], np.quantile(values, 0.5)) and np.isclose(row["b"], np.quantile(values, 0.95))
    assert row["c"] == np.sort(values)[int(np.ceil(0.95 * len(values))) - 1] and row["d"] == values.min()
    ranks = {x["v"]: x["rank"] for x in with_rank(df, "v").collect()}
    assert all(rank == 1 + int((values > v).sum()) for v, rank in ranks.items())


def test_a_narrow_band_of_values_spreads(spark):
    """Microseconds of one day, which lie in few logarithmic buckets, beside a few values far away."""
    rng = np.random.default_rng(6)
    day = 1_700_000_000_000_000 + rng.integers(0, 86_400_000_000, 20_000)
    values = np.concatenate([day, [0, -5, 3, 2**53]]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    spread = bucketed(df, "v", splitters(df, "v")).groupBy("_b").count().collect()
    assert len(spread) >= 500 and max(r["count"] for r in spread) <= 200
    row = percentiles(df, "v", {"a": ("continuous", 0.37), "b": ("nearest", 0.95)}).first()
    assert np.isclose(row["a"], np.quantile(values, 0.37), rtol=1e-15) and row["b"] == np.sort(values)[int(np.ceil(0.95 * len(values))) - 1]
    order = np.sort(values)
    assert all(x["rank"] == len(values) - np.searchsorted(order, x["v"], side="right") + 1 for x in with_rank(df, "v").collect())
