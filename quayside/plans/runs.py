"""Conversations and run logs (C1-C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions.redact import redact_secrets, redact_sql
from quayside.functions.text import collapse_sql, pick, pick_sql
from quayside.operators import conversations as c
from quayside.operators import runs as r
from quayside.plans.registry import query
from quayside.plans.samples import SECRETS
from quayside.sources.commerce import with_views as v

ROUTES = ["SQL", "RAG", "HYBRID", "GENERAL"]


@query("c01_conversation_list",
       """SELECT conv_id, messages, started FROM (SELECT conv_id, min(turn) AS started FROM conversations GROUP BY 1)
       JOIN (SELECT conv_id, count(*) AS messages FROM conversations WHERE role <> 'system' GROUP BY 1) USING (conv_id)
       ORDER BY conv_id DESC LIMIT 100""")
def c01(t):
    headers = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("started"))
    said = t.conversations.filter("role <> 'system'")
    return c.conversation_list(headers, said, "conv_id", F.desc("conv_id"), 100).select("conv_id", "messages", "started")


@query("c02_conversation_titles",
       f"""WITH f AS (SELECT conv_id, {collapse_sql("arg_min(text, turn)")} AS s FROM conversations WHERE role = 'user' GROUP BY 1)
       SELECT conv_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 57)) || '...' END AS title FROM f""")
def c02(t):
    return c.conversation_titles(t.conversations, "conv_id", "turn")


@query("c03_recent_messages",
       """SELECT conv_id, turn, role, md5(text) AS text_md5, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency
       FROM conversations QUALIFY recency <= 4""")
def c03(t):
    return c.recent_messages(t.conversations, "conv_id", "turn", 4).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "recency")


@query("c04_history_window",
       f"""WITH m AS (SELECT conv_id, turn, role, {collapse_sql('text')} AS s, {pick_sql(ROUTES, 'conv_id + turn')} AS route FROM conversations
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8),
       p AS (SELECT *, CASE WHEN length(s) <= 500 THEN s ELSE substr(s, 1, 499) || '…' END AS content,
         CASE WHEN route IN ('SQL', 'HYBRID') THEN '; SQL: SELECT count(*) FROM orders WHERE o_orderkey > ' || turn ELSE '' END ||
         CASE WHEN route = 'HYBRID' THEN '; SQL: SELECT max(o_totalprice) FROM orders' ELSE '' END AS q FROM m),
       l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' || content ELSE 'Assistant: ' || content || ' [route=' || route || q || ']' END AS line FROM p),
       b AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM l)
       SELECT conv_id, array_to_string(list(line ORDER BY turn), chr(10)) AS history, count(*) AS lines FROM b WHERE spent <= 1500 GROUP BY 1""")
def c04(t):
    route = pick(ROUTES, F.col("conv_id") + F.col("turn"))
    first = F.when(route.isin("SQL", "HYBRID"), F.concat(F.lit("SELECT count(*)\n  FROM orders WHERE o_orderkey > "), "turn"))
    sql = F.array(first, F.lit(" "), F.when(route == "HYBRID", F.lit("SELECT max(o_totalprice)\tFROM orders")))
    line = c.history_line(F.col("role"), F.col("text"), route, sql)
    return c.history_window(t.conversations, "conv_id", "turn", line, n=8, max_chars=1500)


@query("c05_run_stats", v(
    """SELECT count(*) AS total_runs, round(count(*) FILTER (WHERE status = 'success') / count(*), 4) AS success_rate,
    round(avg(total_ms), 1) AS avg_latency_ms, round(quantile_cont(total_ms, 0.95), 1) AS p95_latency_ms FROM v_runs WHERE status <> 'running'"""))
def c05(t):
    return r.run_stats(t.commerce.agent_runs())


@query("c06_route_counts", v(
    """WITH n AS (SELECT route, count(*) AS runs FROM v_runs WHERE route IS NOT NULL GROUP BY 1)
    SELECT route, runs, round(runs / sum(runs) OVER (), 6) AS share, round(runs / max(runs) OVER (), 6) AS relative FROM n"""))
def c06(t):
    return r.counts_with_shares(t.commerce.agent_runs(), "route")


RECENT = "SELECT run_id, user_id, status, total_ms FROM v_runs {where} ORDER BY created_at DESC, run_id DESC LIMIT 50"


@query("c07a_recent_runs_of_all", v(RECENT.format(where="")))
def c07a(t):
    return r.recent_runs(t.commerce.agent_runs(), 50).select("run_id", "user_id", "status", "total_ms")


@query("c07b_recent_runs_of_user", v(RECENT.format(where="WHERE user_id = 7")))
def c07b(t):
    return r.recent_runs(t.commerce.agent_runs(), 50, user_id=7).select("run_id", "user_id", "status", "total_ms")


@query("c08_stage_timings", v(
    """WITH s AS (SELECT unnest(['routing', 'retrieval', 'answer_generation']) AS stage,
      unnest([total_ms // 5, total_ms // 3, total_ms - total_ms // 5 - total_ms // 3]) AS ms, status,
      greatest(1, total_ms // 5, total_ms // 3, total_ms - total_ms // 5 - total_ms // 3) AS longest FROM v_runs)
    SELECT stage, count(*) AS runs, round(avg(ms), 3) AS avg_ms, round(sum(ms * 1000000 // longest) / count(*) / 1000000, 4) AS share_of_longest,
    count(*) FILTER (WHERE stage = 'answer_generation' AND status = 'failed') AS errors FROM s GROUP BY 1"""))
def c08(t):
    return r.stage_timings(t.commerce.agent_runs())


@query("c09_token_totals", v(
    """SELECT user_id, CAST(nullif(sum(k % 90), 0) AS BIGINT) AS prompt_tokens, CASE WHEN sum(k % 90) > 0 THEN CAST(sum(k % 90 // 2) AS BIGINT) END AS completion_tokens,
    CASE WHEN sum(k % 90) > 0 THEN CAST(sum(k % 90) + sum(k % 90 // 2) AS BIGINT) END AS total_tokens FROM v_runs GROUP BY 1"""))
def c09(t):
    prompt = F.col("k") % 90
    return r.token_totals(t.commerce.agent_runs(), "user_id", prompt, F.floor(prompt / 2))


@query("c10_failed_run_cleanup",
       """SELECT conv_id, turn, role FROM conversations WHERE NOT (role = 'user' AND turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = conversations.conv_id))""")
def c10(t):
    return c.drop_unanswered(t.conversations, "conv_id", "turn").select("conv_id", "turn", "role")


@query("c11_redact_secrets",
       f"""WITH s AS (SELECT doc_id, text || chr(10) || {pick_sql(SECRETS, 'doc_id')} AS s FROM documents),
       x AS (SELECT doc_id, {redact_sql('s')} AS clean FROM s) SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS characters, substr(clean, -60) AS tail FROM x""")
def c11(t):
    line = F.concat("text", F.lit("\n"), pick(SECRETS, F.col("doc_id")))
    clean = t.spread("documents").select("doc_id", redact_secrets(line).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("bigint").alias("characters"), F.expr("right(clean, 60)").alias("tail"))
