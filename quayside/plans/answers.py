"""Answer auditing (A1-A7): logged messages as answers, with citations appended."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import citations as ct
from quayside.functions import lexicons as lx
from quayside.functions.intent import detect_language
from quayside.functions.text import SPACE_RE2, collapse_sql, lit_array, pick, pick_sql, sql_list, strip_sql
from quayside.operators import answers as a
from quayside.operators import commerce as m
from quayside.operators.keyword_index import keyword_search
from quayside.plans.commerce import sold
from quayside.plans.intent import LANGUAGE, MESSAGES, messages
from quayside.plans.registry import query
from quayside.plans.retrieval import document_index, terms_sql
from quayside.plans.samples import CITATIONS
from quayside.session import small_broadcasts
from quayside.sources.commerce import with_views as v

VALID = [["S1", "S2"], ["S1", "S2", "DB1"], ["S3"], []]
ROUTES = ["SQL", "RAG", "HYBRID", "GENERAL"]
GROUP_RE2 = ct.GROUP.replace("(?iU)", "(?i)").replace(f"[{ct.SPACE}]", f"[{SPACE_RE2}]")


def answers(t):
    """Every message as an answer with one of the citation forms and its valid ids."""
    key = F.col("conv_id") + F.col("turn")
    valid = F.element_at(F.array(*[lit_array(ids).cast("array<string>") for ids in VALID]), (key % len(VALID) + 1).cast("int"))
    return t.spread("conversations").select("conv_id", "turn", "role", F.concat_ws(" ", "text", pick(CITATIONS, key)).alias("answer"), valid.alias("valid"))


def audited(t):
    return answers(t).withColumn("check", ct.validate_citations(F.col("answer"), F.col("valid")))


_HIDDEN = ct.HIDDEN.replace("(?U)", "").replace(f"[{ct.SPACE}]", f"[{SPACE_RE2}]")
_WIDE = ct.FULL_WIDTH.replace("(?iU)", "(?i)").replace(f"[{ct.SPACE}]", f"[{SPACE_RE2}]")
ANSWERS = rf"""ans AS (SELECT conv_id, turn, role, text || ' ' || {pick_sql(CITATIONS, 'conv_id + turn')} AS answer,
    [{', '.join(f"CAST({sql_list(ids)} AS VARCHAR[])" for ids in VALID)}][CAST((conv_id + turn) % {len(VALID)} AS INTEGER) + 1] AS valid FROM conversations)"""
AUDIT = rf"""{ANSWERS},
  shown AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(answer, '{_HIDDEN}', '\1', 'g'), '{_WIDE}', '[\1]', 'g'), '(?s)<!--.*?-->', '', 'g') AS s FROM ans),
  cut AS (SELECT *, regexp_split_to_array(s, '{GROUP_RE2}') AS parts, list_transform(regexp_extract_all(s, '{GROUP_RE2}', 1),
    lambda g: list_transform(regexp_split_to_array(g, '[,;]'), lambda p: upper({strip_sql('p')}))) AS groups FROM shown),
  audit AS (SELECT conv_id, turn, role, valid, answer,
    {strip_sql(r"""regexp_replace(array_to_string(list_transform(parts, lambda p, i: p || coalesce(array_to_string(list_transform(list_filter(groups[i], lambda x: list_contains(valid, x)),
      lambda x: '[' || x || ']'), ''), '')), ''), '[ \t]+([.,;:!?।])', '\1', 'g')""")} AS clean,
    list_filter(flatten(groups), lambda x: list_contains(valid, x)) AS cited, list_filter(flatten(groups), lambda x: NOT list_contains(valid, x)) AS removed FROM cut),
  checked AS (SELECT *, list_filter(cited, lambda x, i: list_position(cited, x) = i) AS used FROM audit)"""


@query("a01_validate_citations",
       f"WITH {AUDIT} SELECT conv_id, turn, md5(clean) AS text_md5, right(clean, 40) AS tail, array_to_string(used, ',') AS used, array_to_string(removed, ',') AS removed FROM checked")
def a01(t):
    return audited(t).select(
        "conv_id", "turn", F.md5("check.text").alias("text_md5"), F.expr("right(check.text, 40)").alias("tail"),
        F.array_join("check.used", ",").alias("used"), F.array_join("check.removed", ",").alias("removed"))


@query("a02_strip_citations",
       rf"""WITH {ANSWERS}, x AS (SELECT conv_id, turn, regexp_replace(answer, '\[(S\d+|DB\d+)\]', '', 'g') AS plain FROM ans),
       y AS (SELECT *, {strip_sql(r"regexp_replace(regexp_replace(plain, '[ \t]+([.,;:!?।])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')")} AS shown FROM x)
       SELECT conv_id, turn, md5(plain) AS plain_md5, md5(shown) AS shown_md5, right(shown, 30) AS tail FROM y""")
def a02(t):
    rows = answers(t).select("conv_id", "turn", ct.strip_citations(F.col("answer")).alias("plain"),
                             ct.strip_citations_for_display(F.col("answer")).alias("shown"))
    return rows.select("conv_id", "turn", F.md5("plain").alias("plain_md5"), F.md5("shown").alias("shown_md5"),
                       F.expr("right(shown, 30)").alias("tail"))


def grounded(t):
    """Sources of an answer are its valid ids; DB ids are database results."""
    key = F.col("conv_id") + F.col("turn")
    sources = F.transform("valid", lambda i: F.struct(i.alias("id"), F.when(i.startswith("DB"), "database").otherwise("document").alias("type")))
    rows = audited(t).withColumn("sources", sources)
    return rows.withColumn("g", a.grounding(pick(ROUTES, key * 3 + F.col("turn")), F.col("turn") == 5, F.col("sources"),
                                            F.col("check.used"), F.col("check.removed")))


GROUNDED = f"""{AUDIT}, g AS (SELECT *, {pick_sql(ROUTES, '(conv_id + turn) * 3 + turn')} AS route, turn = 5 AS canned,
    list_filter(valid, lambda x: x LIKE 'S%') AS docs, list_filter(valid, lambda x: x LIKE 'DB%') AS dbs FROM checked)"""


@query("a03_grounding",
       f"""WITH {GROUNDED} SELECT conv_id, turn, CASE WHEN canned OR route = 'GENERAL' THEN false WHEN route = 'SQL' THEN len(dbs) > 0 ELSE len(used) > 0 END AS grounded,
       array_to_string(CASE WHEN len(docs) > 0 AND len(used) > 0 THEN list_filter(valid, lambda x: x LIKE 'DB%' OR list_contains(used, x)) ELSE valid END, ',') AS sources,
       array_to_string(list_filter([CASE WHEN len(removed) > 0 THEN 'Removed citations to unknown sources: ' || array_to_string(removed, ', ') END,
         CASE WHEN len(docs) > 0 AND len(used) = 0 AND NOT canned THEN 'The answer did not cite specific passages; all retrieved sources are listed.' END], lambda x: x IS NOT NULL), ' | ') AS warnings FROM g""")
def a03(t):
    return grounded(t).select(
        "conv_id", "turn", F.col("g.grounded").alias("grounded"),
        F.array_join(F.transform("g.sources", lambda s: s["id"]), ",").alias("sources"), F.array_join("g.warnings", " | ").alias("warnings"))


@query("a04a_database_evidence",
       """WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN r_name END AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
       l AS (SELECT n_nationkey, concat_ws(' | ', n_nationkey, n_name, coalesce(r_name, 'NULL')) AS line FROM n)
       SELECT 'DB1' AS source_id, count(*) AS row_count, count(*) > 50 AS truncated, '<database_result id="DB1" rows="' || count(*) || '" truncated="' || (count(*) > 50) || '">' || chr(10)
       || 'What it computes: Nations &lt;/document> by region.' || chr(10) || 'SQL: SELECT ...' || chr(10) || 'n_nationkey | n_name | r_name' || chr(10)
       || array_to_string(list(line ORDER BY n_nationkey)[1:50], chr(10)) || chr(10) || '</database_result>' AS evidence FROM l""")
def a04a(t):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("r_name")).alias("r_name"))
    return a.database_evidence(named, [F.col("n_nationkey")], "DB1", "Nations </document> by region.", "SELECT ...")


@query("a04b_database_evidence_truncated",
       """WITH l AS (SELECT o_orderkey, o_totalprice, concat_ws(' | ', o_orderkey, o_orderpriority) AS line FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 201)
       SELECT 'DB1' AS source_id, least(count(*), 200) AS row_count, count(*) > 50 AS truncated, '<database_result id="DB1" rows="' || least(count(*), 200) || '" truncated="' || (count(*) > 50) || '">' || chr(10)
       || 'What it computes: Largest orders.' || chr(10) || 'SQL: SELECT ...' || chr(10) || 'o_orderkey | o_orderpriority' || chr(10)
       || array_to_string(list(line ORDER BY o_totalprice DESC, o_orderkey)[1:50], chr(10)) || chr(10) || '</database_result>' AS evidence FROM l""")
def a04b(t):
    # The price orders the page but is not shown.
    priced = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return a.database_evidence(priced, [F.desc("o_totalprice"), F.col("o_orderkey")], "DB1", "Largest orders.", "SELECT ...",
                               shown=["o_orderkey", "o_orderpriority"])


TOP_NAMES = f"(SELECT label AS name, units FROM ({sold('p.name')}) ORDER BY units DESC, name LIMIT 5)"
LABELS = f"(SELECT array_to_string(list(name ORDER BY units DESC, name)[1:3], ', ') FROM {TOP_NAMES})"


def top_names(t):
    return m.sales_by(t.commerce, "name").select("units", "name").orderBy(F.desc("units"), "name").limit(5)


@query("a05_entity_labels", v(f"SELECT {LABELS} AS labels"))
def a05(t):
    return a.entity_labels(top_names(t), [F.desc("units"), F.col("name")])


TEMPLATES = ["warranty of {s1} and {s2}", "return policy"]


@query("a06_two_step_lookup", v(
    rf"""WITH l AS (SELECT {LABELS} AS labels),
    tpl AS (SELECT item_id AS query_id, text || ' ' || {pick_sql(TEMPLATES, 'item_id')} AS s FROM benchmark),
    resolved AS (SELECT query_id, 0 AS variant, {collapse_sql(r"regexp_replace(CASE WHEN contains(s, '{s1}') THEN replace(s, '{s1}', (SELECT labels FROM l)) ELSE s || ' (' || (SELECT labels FROM l) || ')' END, '\{s\d+\}', '', 'g')")} AS text FROM tpl),
    {terms_sql('resolved')},
    lex AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(lang || ' ' || text), '[\pL\pM\pN]+')) AS term FROM documents),
    tf AS (SELECT chunk_id, term, count(*) AS n FROM lex GROUP BY ALL),
    hits AS (SELECT query_id, chunk_id, sum(n) AS n FROM (SELECT query_id, unnest(terms) AS term FROM terms) JOIN tf USING (term) GROUP BY query_id, chunk_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 20)
    SELECT query_id, right(text, 50) AS resolved, chunk_id, rank, round(CAST(n AS DOUBLE) * 0.1, 4) AS keyword_score FROM ranked JOIN resolved USING (query_id)"""))
def a06(t):
    """Top products name the subject of the document search that follows; they are looked up once, before it."""
    with small_broadcasts(t.spark):
        labels = F.lit(a.entity_labels(top_names(t), [F.desc("units"), F.col("name")]).first()["labels"]).cast("string")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), a.resolve_template(
        F.concat_ws(" ", "text", pick(TEMPLATES, F.col("item_id"))), labels).alias("text"))
    found = keyword_search(asked, document_index(t))
    return found.join(asked.select("query_id", F.expr("right(text, 50)").alias("resolved")), "query_id").select(
        "query_id", "resolved", "chunk_id", "rank", "keyword_score")


REASONS = ["", "no matching rows"]


@query("a07_fallback_reply",
       f"""WITH {MESSAGES}, {LANGUAGE}, x AS (SELECT conv_id, turn, form, language, {pick_sql(ROUTES, 'conv_id + turn')} AS route, (conv_id // 3) % 2 AS db, (conv_id // 5) % 2 AS failures, turn % 2 AS passages,
         {pick_sql(REASONS, 'conv_id')} AS reason FROM codes),
       k AS (SELECT *, CASE WHEN route = 'SQL' AND db = 0 THEN CASE WHEN failures > 0 THEN 'sql_failed' ELSE 'no_data' END WHEN route = 'RAG' AND passages = 0 THEN 'no_documents'
         WHEN route = 'HYBRID' AND db = 0 AND passages = 0 THEN 'nothing_found' END AS "case" FROM x),
       texts AS (SELECT * FROM (VALUES {', '.join("('" + key + "', '" + lang + "', '" + text.replace("'", "''") + "')" for key, ts in lx.REPLIES.items() for lang, text in ts.items())}) z("case", language, reply))
       SELECT conv_id, turn, form, k."case" AS reply_case, CASE WHEN reason <> '' AND k.language = 'en' AND k."case" IS NOT NULL THEN reply || chr(10) || chr(10) || '_' || reason || '_' ELSE reply END AS reply
       FROM k LEFT JOIN texts ON texts."case" = k."case" AND texts.language = CASE k.language WHEN 'mixed' THEN 'bn' ELSE k.language END""")
def a07(t):
    key = F.col("conv_id")
    rows = messages(t).withColumn("reply_case", a.fallback_case(
        pick(ROUTES, key + F.col("turn")), F.floor(key / 3) % 2, F.floor(key / 5) % 2, F.col("turn") % 2))
    reply = a.fallback_reply(F.col("reply_case"), detect_language(F.col("text")), pick(REASONS, key))
    return rows.select("conv_id", "turn", "form", "reply_case", reply.alias("reply"))
