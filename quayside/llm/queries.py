"""Registered queries of the operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle.strip()
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from quayside.llm import packing
    from quayside.llm.common import Store

    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), Store(spark, "packing"))


@query("op10_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from quayside.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op3_url_filters")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import urls

    return urls.judge(table(spark, folder, "pages"), urls.local_table(spark, urls.labelled_urls()))


@query("op2_toxicity")
def toxicity_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import toxicity
    from quayside.llm.common import Store

    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, folder, "labels"), Store(spark, "toxicity")))


@query("op5_quality_classifier")
def quality_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import quality
    from quayside.llm.common import fold

    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"), fold("doc_id", 3) != 1)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("score"), F.col("predicted"))


@query("op8_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from quayside.llm import lm
    from quayside.llm.common import Store, fold

    path = public_tokenizers.path("piece_bpe_32k.model")
    return lm.score_documents(table(spark, folder, "documents"), fold("doc_id", 5) == 1, path, Store(spark, "lm"))


@query("op1_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import ann
    from quayside.llm.common import Store

    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, Store(spark, "ann"))


@query("op7_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN degree d USING (vec_id)
""")
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import embed_dedup
    from quayside.llm.common import Store

    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"), Store(spark, "vectors"))


@query("op6_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams FROM w
), s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * k >= 90 * (na + nb - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT g.doc_id, any_value(len(g.grams))::BIGINT AS n_shingles, min(r.b) AS component_id FROM g JOIN reach r ON g.doc_id = r.a GROUP BY g.doc_id
""")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import ngram_join
    from quayside.llm.common import Store

    return ngram_join.jaccard_components(table(spark, folder, "documents"), Store(spark, "join"))


@query("op4_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import substring
    from quayside.llm.common import Store

    return substring.repeats(table(spark, folder, "documents"), Store(spark, "substring"))


@query("op13_sharding")
def sharding_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import sharding
    from quayside.llm.common import Store

    return sharding.shard_documents(table(spark, folder, "documents"), Store(spark, "sharding"))


def _centroid_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Each round is an assignment of all vectors and the means of the clusters, in whole numbers."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT v.row, arg_min(k.c, k.d * 16 + k.c) AS c, min(k.d) AS d FROM (
    SELECT v.row, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM v, c{r} c
  ) k JOIN v USING (row) GROUP BY v.row
)"""
    means = """
s{r} AS MATERIALIZED (
  SELECT a.c, i.i, sum(v.e[i.i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (row), range(1, 65) i(i) GROUP BY a.c, i.i
), c{n} AS MATERIALIZED (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{r} c
  LEFT JOIN (SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS e FROM s{r} GROUP BY c) m USING (c)
)"""
    parts = ["""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""", f"""
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS c, e FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {clusters}
)"""]
    for r in range(rounds):
        parts += [assign.format(r=r), means.format(r=r, n=r + 1)]
    parts.append(assign.format(r=rounds))
    return "WITH " + ",".join(parts) + f"""
SELECT v.vec_id, a.c AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c USING (c)"""


@query("op11_centroid_clustering", _centroid_sql())
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import centroids
    from quayside.llm.common import Store

    return centroids.digest(centroids.cluster(table(spark, folder, "embeddings"), Store(spark, "centroids")))


@query("op12_source_divergence", r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS MATERIALIZED (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS c FROM t GROUP BY lang, term HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, sum(n) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
of_groups AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0)::HUGEINT + 1)) // (coalesce(o.n, 0) + l.v) AS p,
    1 + (1000000000 * (k.c::HUGEINT + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN of_groups o USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f.value), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  GROUP BY a.lang, a.source, b.source
), both_parts AS (SELECT * FROM term UNION ALL SELECT * FROM pair)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER w)::INTEGER AS rank FROM both_parts
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 200
""")
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    from quayside.llm import divergence
    from quayside.llm.common import Store

    return divergence.audit(table(spark, folder, "documents"), Store(spark, "divergence"))
