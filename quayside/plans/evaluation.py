"""Evaluation metrics (E1-E8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions.text import collapse_sql, lit_array, pick, pick_sql, sql_list
from quayside.operators import evaluation as e
from quayside.plans import registry
from quayside.plans.answers import AUDIT, audited
from quayside.plans.registry import query
from quayside.plans.retrieval import FUSE_SQL, K, corpus, queries
from quayside.operators import retrieval as r
from quayside.sources.commerce import with_views as v

FACTS = ["Takes ৩০ days, 3,000 at most", "It is   HALF of the price", "nothing of the kind"]
GROUPS = [[["30", "thirty"], ["3,000", "3000"]], [["50%", "half"]], [["days"], ["kind"]]]


def _groups_sql() -> str:
    return "[" + ", ".join("[" + ", ".join(sql_list(g) for g in groups) + "]" for groups in GROUPS) + "]"


@query("e01_contains_all_groups",
       f"""WITH x AS (SELECT conv_id, turn, {collapse_sql(f"lower(translate(text || ' ' || {pick_sql(FACTS, 'conv_id')}, '০১২৩৪৫৬৭৮৯', '0123456789'))")} AS s,
       {_groups_sql()}[CAST((conv_id + turn) % 3 AS INTEGER) + 1] AS g FROM conversations)
       SELECT conv_id, turn, len(list_filter(g, lambda o: len(list_filter(o, lambda y: contains(s, lower(y)))) > 0)) = len(g) AS answer_correct FROM x""")
def e01(t):
    key = F.col("conv_id") + F.col("turn")
    groups = F.element_at(F.array(*[F.array(*[lit_array(g) for g in gs]) for gs in GROUPS]), (key % len(GROUPS) + 1).cast("int"))
    return t.spread("conversations").select("conv_id", "turn", e.contains_all_groups(
        F.concat_ws(" ", "text", pick(FACTS, F.col("conv_id"))), groups).alias("answer_correct"))


@query("e02_result_matches",
       """WITH g AS (SELECT c_nationkey AS item, c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 2) AS balance FROM customer GROUP BY ALL),
       a AS (SELECT item, upper(segment) AS segment, n + CASE WHEN item % 3 = 1 AND segment = 'BUILDING' THEN 1 ELSE 0 END AS n, balance FROM g WHERE NOT (item % 3 = 2 AND segment = 'FURNITURE'))
       SELECT n_nationkey AS item, (SELECT count(*) FROM g WHERE item = n_nationkey) = (SELECT count(*) FROM a WHERE item = n_nationkey)
         AND NOT EXISTS (SELECT 1 FROM g WHERE g.item = n_nationkey AND NOT EXISTS (SELECT 1 FROM a WHERE a.item = g.item AND lower(a.segment) = lower(g.segment) AND a.n = g.n AND a.balance = g.balance)) AS matches FROM nation""")
def e02(t):
    """Gold: customers per segment of each nation. The agent's answer has other letters, columns
    and order; for some nations a count is wrong or a row is missing."""
    gold = t.customer.groupBy(F.col("c_nationkey").alias("item"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("balance"))
    wrong = F.when((F.col("item") % 3 == 1) & (F.col("segment") == "BUILDING"), 1).otherwise(0)
    agent = gold.filter("not (item % 3 = 2 and segment = 'FURNITURE')").select(
        "item", F.col("balance"), F.lit(True).alias("extra"), (F.col("n") + wrong).cast("decimal(12,2)").alias("n"),
        F.upper("segment").alias("segment"), (-F.col("n")).alias("at"))
    return e.result_matches(
        t.nation.select(F.col("n_nationkey").alias("item")), gold.withColumn("at", F.col("segment")), agent, "item", "at")


@query("e03_retrieval_scores",
       f"""WITH {FUSE_SQL}, found AS (SELECT query_id AS item, section AS source FROM results JOIN ch USING (chunk_id) WHERE rank <= {K}),
       items AS (SELECT item_id AS item, {pick_sql(['en', 'fr', 'de', 'es'], 'item_id')} AS one FROM benchmark)
       SELECT item, count(*) FILTER (WHERE source IN (one, 'en')) > 0 AS hit, round(coalesce(count(*) FILTER (WHERE source IN (one, 'en')) / nullif(count(source), 0), 0), 6) AS precision
       FROM items LEFT JOIN found USING (item) GROUP BY item""")
def e03(t):
    """Expected sources of a query: English documents and those of one more language."""
    languages = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("source"))
    found = r.hybrid_search(queries(t), k=K, **corpus(t)).join(languages, "chunk_id").select(F.col("query_id").alias("item"), "source")
    items = t.benchmark.select(F.col("item_id").alias("item"))
    expected = items.select("item", pick(["en", "fr", "de", "es"], F.col("item")).alias("source")).unionByName(
        items.select("item", F.lit("en").alias("source")))
    return e.retrieval_scores(items, found, expected).withColumn("precision", F.round("precision", 6))


@query("e04_rates",
       """SELECT 'good' AS metric, round(avg(quality), 9) AS value, count(*) AS n FROM labels
       UNION ALL SELECT 'toxic', round(avg(toxic), 9), count(*) FROM labels UNION ALL SELECT 'never', NULL, 0""")
def e04(t):
    flags = t.labels.select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), F.lit(None).cast("boolean").alias("never"))
    return e.rates(flags, "good", "toxic", "never").withColumn("value", F.round("value", 9))


@query("e05_latency_percentiles", v(
    "SELECT quantile_cont(total_ms, 0.5) AS p50, CAST(quantile_disc(total_ms, 0.95) AS DOUBLE) AS p95 FROM v_runs"))
def e05(t):
    return e.latency_summary(t.commerce.agent_runs(), "total_ms")


def item_results(t):
    """Results per document: judged ones have a route, the rest only a latency."""
    key, judged = F.col("doc_id"), t.labels
    return t.documents.select("doc_id", "lang", "n_chars").join(judged, "doc_id", "left").select(
        F.col("lang").alias("category"), (F.col("quality") == 1).alias("route_correct"),
        F.when(key % 2 == 0, F.col("toxic") == 0).alias("sql_correct"),
        F.when(key % 3 != 0, key % 7 < 4).alias("retrieval_hit"),
        F.when(key % 3 != 0, (key % 5) / 5).alias("retrieval_precision"),
        F.when(key % 3 != 0, key % 11 < 9).alias("citation_correct"),
        F.when(key % 4 == 1, key % 13 < 6).alias("answer_correct"),
        F.when(key % 6 == 2, e.hybrid_success(F.col("quality") == 1, F.col("toxic") == 0, key % 7 < 4)).alias("hybrid_success"),
        F.when(key % 50 == 49, "llm_unavailable").alias("error"), F.when(key % 50 != 49, F.col("n_chars")).alias("latency_ms"))


def _summary_sql() -> str:
    metric = lambda name: f"SELECT 'all' AS category, '{name}' AS metric, avg(CAST({name} AS INTEGER)) AS value, count({name}) AS n FROM i"
    return f"""WITH i AS (SELECT lang AS category, quality = 1 AS route_correct, CASE WHEN doc_id % 2 = 0 THEN toxic = 0 END AS sql_correct, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 < 4 END AS retrieval_hit,
      CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 / 5 END AS retrieval_precision, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 11 < 9 END AS citation_correct, CASE WHEN doc_id % 4 = 1 THEN doc_id % 13 < 6 END AS answer_correct,
      CASE WHEN doc_id % 6 = 2 THEN coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND doc_id % 7 < 4 END AS hybrid_success, doc_id % 50 = 49 AS failed,
      CASE WHEN doc_id % 50 <> 49 THEN n_chars END AS latency_ms FROM documents LEFT JOIN labels USING (doc_id)),
    m AS ({' UNION ALL '.join(metric(name) for name in e.METRICS)}
      UNION ALL SELECT category, 'route_correct', avg(CAST(route_correct AS INTEGER)), count(route_correct) FROM i GROUP BY category
      UNION ALL SELECT 'all', 'retrieval_precision', avg(retrieval_precision), count(retrieval_precision) FROM i
      UNION ALL SELECT 'all', 'errors', count(*) FILTER (WHERE failed), count(*) FROM i
      UNION ALL SELECT 'all', 'latency_p50', quantile_cont(latency_ms, 0.5), count(latency_ms) FROM i
      UNION ALL SELECT 'all', 'latency_p95', quantile_disc(latency_ms, 0.95), count(latency_ms) FROM i)
    SELECT category, metric, round(CAST(value AS DOUBLE), 6) AS value, n FROM m"""


@query("e06_summary", _summary_sql())
def e06(t):
    return e.summarise(item_results(t)).withColumn("value", F.round("value", 6))


FILES = ["Return_Policy.md", "Refund_Policy.md", "Shipping_Policy.md"]


@query("e07_citation_correct_and_hybrid_success",
       f"""WITH {AUDIT}, x AS (SELECT conv_id, turn, clean, used, list_filter(used, lambda u: u LIKE 'S%') AS cited, {pick_sql(FILES, 'conv_id')} AS expected FROM checked),
       y AS (SELECT *, list_transform(cited, lambda u: {sql_list(FILES)}[CAST(substr(u, 2) AS INTEGER)]) AS files FROM x)
       SELECT conv_id, turn, len(cited) > 0 AND list_contains(files, expected) AND len(list_filter(cited, lambda u: contains(clean, '[' || u || ']'))) = len(cited) AS citation_correct,
       turn % 2 = 0 AND conv_id % 3 <> 0 AND len(cited) > 0 AS hybrid_success FROM y""")
def e07(t):
    """Passage S1 comes from the first file, S2 from the second, S3 from the third."""
    passages = F.filter("check.used", lambda u: u.startswith("S"))
    cited = F.transform(passages, lambda u: F.struct(
        u.alias("id"), F.element_at(lit_array(FILES), F.substring(u, 2, 9).cast("int")).alias("filename")))
    rows = audited(t).withColumn("cited", cited)
    expected = F.array(pick(FILES, F.col("conv_id")))
    return rows.select(
        "conv_id", "turn", e.citation_correct(F.col("check.text"), F.col("cited"), expected).alias("citation_correct"),
        e.hybrid_success(F.col("turn") % 2 == 0, F.col("conv_id") % 3 != 0, F.size("cited") > 0).alias("hybrid_success"))


GOLD = [f"q{n:02d}_" for n in range(1, 34)]


def gold_queries():
    return {name: q for name, q in registry.QUERIES.items() if name.startswith(tuple(GOLD))}


@query("e08_gold_query_health", " UNION ALL ".join(
    f"SELECT '{name}' AS query, (SELECT count(*) FROM ({q.oracle})) > 0 AS has_rows" for name, q in gold_queries().items()))
def e08(t):
    return e.query_health({name: q.build(t) for name, q in gold_queries().items()})
