"""Language and intent (L1-L9) over the conversation log.

The log is written in invented words; every message gets one of the sample questions
appended, so that all four language codes and all routes occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import intent as i
from quayside.functions import lexicons as lx
from quayside.functions.text import SPACE_RE2, collapse_sql, pick, pick_sql, sql_list
from quayside.operators import routing as r
from quayside.plans.registry import query
from quayside.plans.samples import QUESTIONS

KEY = "conv_id * 5 + turn"
BN = r"[\x{980}-\x{9ff}]"


def messages(t):
    """Every message twice: the sample question alone, and with the logged text before it."""
    base = t.spread("conversations").withColumn("question", pick(QUESTIONS, F.col("conv_id") * 5 + F.col("turn")))
    alone = base.select("conv_id", "turn", "role", F.lit("question").alias("form"), F.col("question").alias("text"))
    return alone.unionByName(base.select(
        "conv_id", "turn", "role", F.lit("whole").alias("form"), F.concat_ws(" ", "text", "question").alias("text")))


MESSAGES = f"""m AS (SELECT conv_id, turn, role, 'question' AS form, {pick_sql(QUESTIONS, KEY)} AS text FROM conversations
    UNION ALL SELECT conv_id, turn, role, 'whole', text || ' ' || {pick_sql(QUESTIONS, KEY)} FROM conversations)"""

LANGUAGE = f"""lang AS (SELECT *, len(regexp_extract_all(text, '{BN}')) AS bengali, len(regexp_extract_all(text, '[A-Za-z]|{BN}')) AS letters,
    regexp_extract_all(lower(text), '[a-z]+') AS latin FROM m),
  hits AS (SELECT *, len(list_filter(latin, lambda w: list_contains({sql_list(sorted(lx.BANGLISH))}, w))) AS hits, len(latin) AS words FROM lang),
  codes AS (SELECT conv_id, turn, role, form, text, CASE WHEN letters > 0 THEN round(bengali / letters, 3) ELSE 0 END AS bengali_ratio,
    CASE WHEN bengali > 0 AND bengali / letters >= 0.85 AND words <= 1 THEN 'bn' WHEN bengali > 0 THEN 'mixed'
         WHEN hits >= 2 AND hits / words >= 0.25 THEN 'banglish' WHEN hits = 1 AND words <= 3 THEN 'banglish' ELSE 'en' END AS language FROM hits)"""


@query("l01_detect_language", f"WITH {MESSAGES}, {LANGUAGE} SELECT conv_id, turn, form, language, CAST(bengali_ratio AS DOUBLE) AS bengali_ratio FROM codes")
def l01(t):
    return messages(t).select("conv_id", "turn", "form", i.detect_language(F.col("text")).alias("language"),
                              i.bengali_ratio(F.col("text")).alias("bengali_ratio"))


@query("l02_language_distribution", f"WITH {MESSAGES}, {LANGUAGE} SELECT form, language, count(*) AS messages FROM codes GROUP BY ALL")
def l02(t):
    return messages(t).groupBy("form", i.detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("messages"))


def hits_sql(terms, text: str = "padded") -> str:
    return (f"len(list_filter({sql_list(terms)}, lambda t: CASE WHEN regexp_matches(t, '^[\\x00-\\x7f]*$') THEN "
            f"regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape(t) || '($|[^a-z0-9])') ELSE contains({text}, t) END))")


@query("l03_keyword_hits",
       f"""WITH {MESSAGES}, p AS (SELECT *, lower(text) AS padded FROM m)
       SELECT conv_id, turn, form, {', '.join(f"CAST({hits_sql(terms)} AS INTEGER) AS {name}" for name, terms in lx.TABLE_TERMS.items())} FROM p""")
def l03(t):
    hits = messages(t).withColumn("hits", i.hits_per_table(F.col("text")))
    return hits.select("conv_id", "turn", "form", "hits.*")


def intent_sql(source: str, text: str = "text") -> str:
    """CTE ``intent`` over a source with a text column."""
    tables = ", ".join(f"CASE WHEN {hits_sql(terms)} > 0 THEN '{name}' END" for name, terms in lx.TABLE_TERMS.items())
    joined = " OR ".join(f"contains(padded, '{c}')" for c in lx.CONJUNCTIONS)
    return f"""pad AS (SELECT *, ' ' || regexp_replace(lower({text}), '[{SPACE_RE2}]+', ' ', 'g') || ' ' AS padded FROM {source}),
    sig AS (SELECT *, list_filter([{tables}], lambda x: x IS NOT NULL) AS tables, {hits_sql(lx.ANALYTICS_TERMS)} AS analytics,
      {hits_sql(lx.DOCUMENT_TERMS)} AS documents_n, {hits_sql(lx.COMPANY_TERMS)} AS company, {hits_sql(lx.GENERAL_TERMS)} AS general, ({joined}) AS joined FROM pad),
    scores AS (SELECT *, CAST(CASE WHEN len(tables) = 0 THEN 0 WHEN analytics > 0 THEN len(tables) * 0.6 + analytics ELSE len(tables) * 0.4 END AS DOUBLE) AS db,
      CAST(documents_n + CASE WHEN company > 0 AND documents_n > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS doc FROM sig),
    intent AS (SELECT *, array_to_string(tables, ',') AS matched_tables, CAST(general AS DOUBLE) AS general_score, round(db, 2) AS db_score, round(doc, 2) AS doc_score,
      CASE WHEN db >= 1.5 AND doc >= 1 AND (joined OR doc >= 2) THEN 'HYBRID' WHEN db > doc AND db >= 1 THEN 'SQL' WHEN doc >= 1 OR company > 0 THEN 'RAG' ELSE 'GENERAL' END AS route,
      round(least(0.9, CAST(CASE WHEN db >= 1.5 AND doc >= 1 AND (joined OR doc >= 2) THEN 0.55 + least(0.3, 0.05 * (db + doc))
        WHEN db > doc AND db >= 1 THEN 0.5 + least(0.4, 0.1 * (db - doc + 1)) WHEN doc >= 1 THEN 0.5 + least(0.4, 0.1 * (doc - db + 1))
        WHEN company > 0 THEN 0.45 ELSE 0.5 + least(0.3, 0.1 * general) END AS DOUBLE)), 3) AS confidence FROM scores)"""


@query("l04_classify_intent",
       f"""WITH {MESSAGES}, {intent_sql('m')} SELECT conv_id, turn, form, matched_tables, general_score, db_score, doc_score, route, CAST(confidence AS DOUBLE) AS confidence FROM intent""")
def l04(t):
    return i.with_intent(messages(t), F.col("text")).select(
        "conv_id", "turn", "form", F.array_join("matched_tables", ",").alias("matched_tables"), "general_score",
        "db_score", "doc_score", "route", "confidence")


FOLLOWING = ["How many of them were cancelled?", "Which brand leads?", "Are those eligible for a refund?", "Eta ki policy?", "ওগুলো কত?"]


@query("l05_inherit_subject",
       rf"""WITH m AS (SELECT conv_id, turn, role, text || ' ' || {pick_sql(FOLLOWING, KEY)} AS text FROM conversations),
       w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM m),
       f AS (SELECT *, previous IS NOT NULL AND regexp_matches(text, '(?i)(^|[^\pL\pN_])({'|'.join(lx.FOLLOW_UPS)})($|[^\pL\pN_])') AS inherited FROM w WHERE role = 'user')
       SELECT conv_id, turn, inherited, md5(CASE WHEN inherited THEN previous || ' ' || text ELSE text END) AS signal_md5 FROM f""")
def l05(t):
    asked = t.conversations.withColumn(
        "text", F.concat_ws(" ", "text", pick(FOLLOWING, F.col("conv_id") * 5 + F.col("turn"))))
    return r.inherit_subject(asked, "conv_id", "turn").select("conv_id", "turn", "inherited", F.md5("signal_text").alias("signal_md5"))


ROUTES = ["SQL", "RAG", "HYBRID", "GENERAL"]


@query("l06_fuse_route",
       f"""WITH e AS (SELECT event_id, {pick_sql(ROUTES, 'event_id')} AS model_route, (event_id // 4 % 101) / 100 AS model_confidence,
         (user_id * 7 + event_id) % 100 / 100 AS relevance, event_id // 404 % 3 AS documents, event_type = 'view' AS asks_clarification,
         {pick_sql(QUESTIONS, 'event_id // 7')} AS text FROM events),
       asked AS (SELECT DISTINCT text FROM e), {intent_sql('asked')},
       g AS (SELECT event_id, model_route, model_confidence AS mc, route AS guess, CAST(confidence AS DOUBLE) AS sure, db_score AS dbs, relevance, documents, asks_clarification FROM e JOIN intent USING (text)),
       s AS (SELECT *, model_route = 'GENERAL' AND guess <> 'GENERAL' AND sure >= 0.6 AS s1 FROM g),
       s2 AS (SELECT *, NOT s1 AND model_route = 'GENERAL' AND relevance >= 0.65 AS s2 FROM s),
       s3 AS (SELECT *, NOT s1 AND NOT s2 AND model_route IN ('SQL', 'HYBRID') AND guess = 'RAG' AND dbs < 1 AND relevance >= 0.35 AS s3 FROM s2),
       x AS (SELECT *, CASE WHEN s1 THEN guess WHEN s2 OR s3 THEN 'RAG' ELSE model_route END AS r0,
             CASE WHEN s1 OR s3 THEN least(mc, sure) WHEN s2 THEN least(mc, 0.7) ELSE mc END AS c0 FROM s3),
       y AS (SELECT *, r0 = 'HYBRID' AND documents = 0 AS s4, CASE WHEN r0 = 'HYBRID' AND documents = 0 THEN 'SQL' ELSE r0 END AS route FROM x),
       z AS (SELECT *, CAST(CASE WHEN route = guess THEN least(0.99, 0.75 * c0 + 0.25) WHEN guess <> 'GENERAL' AND sure >= 0.6 THEN c0 * 0.85 ELSE c0 END AS DOUBLE) AS c FROM y)
       SELECT event_id, route, round(c, 6) AS confidence, s1 OR s2 OR s3 OR s4 AS adjusted,
         array_to_string(list_filter([CASE WHEN s1 THEN 'company-data signals point to ' || guess END, CASE WHEN s2 THEN 'a knowledge-base document closely matches the question' END,
           CASE WHEN s3 THEN 'no data aggregation requested and a policy document matches' END, CASE WHEN s4 THEN 'knowledge base is empty, using the database only' END], lambda q: q IS NOT NULL), '; ') AS overrides,
         asks_clarification AND c < 0.4 AS needs_clarification FROM z""")
def l06(t):
    """Decisions derived from the events: model route and confidence, document match, inventory."""
    e = F.col("event_id")
    logged = t.spread("events").select(
        "event_id", pick(ROUTES, e).alias("model_route"), (F.floor(e / 4) % 101 / 100).alias("model_confidence"),
        ((F.col("user_id") * 7 + e) % 100 / 100).alias("relevance"), (F.floor(e / 404) % 3).alias("documents"),
        (F.col("event_type") == "view").alias("asks_clarification"), pick(QUESTIONS, F.floor(e / 7)).alias("text"))
    guessed = i.with_intent(logged, F.col("text")).withColumnsRenamed({"route": "heuristic_route", "confidence": "heuristic_confidence"})
    return r.fuse_route(guessed, digits=6).select(
        "event_id", "route", "confidence", (F.col("source") != "llm").alias("adjusted"),
        "overrides", "needs_clarification")


@query("l07_heuristic_fallback",
       f"""WITH {MESSAGES}, {intent_sql('m')}, x AS (SELECT *, (conv_id * 31 + turn * 17) % 100 / 100 AS relevance FROM intent)
       SELECT conv_id, turn, form, CASE WHEN route = 'GENERAL' AND relevance >= 0.55 THEN 'RAG' ELSE route END AS route, least(CAST(confidence AS DOUBLE), 0.7) AS confidence FROM x""")
def l07(t):
    rows = i.with_intent(messages(t), F.col("text"))
    relevance = (F.col("conv_id") * 31 + F.col("turn") * 17) % 100 / 100
    route, confidence = r.heuristic_fallback(F.col("route"), F.col("confidence"), relevance)
    return rows.select("conv_id", "turn", "form", route.alias("route"), confidence.alias("confidence"))


DIGITS = ["মোট ১২৩৪৫৬৭৮৯০  টাকা", "TOTAL is\t42", "দাম ৫০%"]


@query("l08_normalise_answer",
       f"""WITH x AS (SELECT conv_id, turn, {collapse_sql(f"lower(translate(text || chr(10) || {pick_sql(DIGITS, 'turn')}, '০১২৩৪৫৬৭৮৯', '0123456789'))")} AS s FROM conversations)
       SELECT conv_id, turn, md5(s) AS text_md5, right(s, 20) AS tail FROM x""")
def l08(t):
    raw = F.concat("text", F.lit("\n"), pick(DIGITS, F.col("turn")))
    return t.spread("conversations").select("conv_id", "turn", i.normalise_answer(raw).alias("s")).select(
        "conv_id", "turn", F.md5("s").alias("text_md5"), F.expr("right(s, 20)").alias("tail"))


@query("l09_detect_script", f"WITH {MESSAGES} SELECT conv_id, turn, form, CASE WHEN regexp_matches(text, '{BN}') THEN 'bengali' ELSE 'latin' END AS script FROM m")
def l09(t):
    return messages(t).select("conv_id", "turn", "form", i.detect_script(F.col("text")).alias("script"))
