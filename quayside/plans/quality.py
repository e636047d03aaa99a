"""Sources, sinks and data quality (S1-S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import evaluation
from quayside.operators import quality as q
from quayside.plans.registry import query
from quayside.sources import files, snapshots
from quayside.sources.chunk_table import ChunkTable
from quayside.sources.commerce import ORDER_STATUS, with_views as v
from quayside.sources.tables import ROW_KEYS, SCHEMAS
from quayside.streaming.run import new_folder


def corpus_files(t):
    """Documents as files: extension and encoding vary with the key (fixture built by Spark)."""
    raw = F.col("text").cast("binary")
    kind = F.pmod(F.col("doc_id"), F.lit(5))
    content = (
        F.when(kind == 0, raw)
        .when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        # Never UTF-8 (FF) and never UTF-16 (odd length).
        .when((kind == 3) & (F.octet_length("text") % 2 == 0), F.concat(raw, F.unhex(F.lit("FF"))))
        .when(kind == 3, F.concat(raw, F.unhex(F.lit("FFFF"))))
        .otherwise(raw)
    )
    ext = F.element_at(F.array(*map(F.lit, ["md", "markdown", "TXT", "csv", "exe"])), (kind + 1).cast("int"))
    return t.spread("documents").select("doc_id", F.concat(F.lit("/in/doc_"), "doc_id", F.lit("."), ext).alias("path"), content.alias("content"))


@query("s01_read_corpus",
       """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'markdown' WHEN 2 THEN 'txt' WHEN 3 THEN 'csv' END AS source_type,
       CASE WHEN doc_id % 5 < 3 THEN md5(text) END AS text_md5, CASE WHEN doc_id % 5 < 3 THEN length(text) END AS characters,
       CASE doc_id % 5 WHEN 3 THEN 'Text files must be UTF-8 encoded.' WHEN 4 THEN 'Unsupported file type.' END AS error FROM documents""")
def s01(t):
    return files.decode_corpus(corpus_files(t)).select("doc_id", "source_type", F.md5("text").alias("text_md5"),
                       F.length("text").cast("bigint").alias("characters"), "error")


@query("s02_rows_to_passages",
       """SELECT c_custkey, 'c_custkey: ' || c_custkey || '; c_name: ' || trim(c_name) || '; c_nationkey: ' || c_nationkey ||
       '; c_acctbal: ' || c_acctbal || CASE WHEN c_mktsegment <> '' THEN '; c_mktsegment: ' || trim(c_mktsegment) ELSE '' END AS passage FROM customer""")
def s02(t):
    return files.rows_to_passages(t.customer).select("c_custkey", "passage")


VARIANTS = ["md", "pdf", "pdf", "docx", "docx", "txt", "txt", "exe", "csv"]


@query("s03_validate_files",
       """WITH f AS (SELECT doc_id, CAST(doc_id % 9 AS INTEGER) AS k, strlen(text) AS bytes FROM documents),
       s AS (SELECT *, CASE k WHEN 1 THEN bytes + 5 WHEN 3 THEN bytes + 21 WHEN 5 THEN bytes + 1 WHEN 6 THEN bytes * 0 ELSE bytes END AS size FROM f)
       SELECT doc_id, CASE k WHEN 7 THEN 'Unsupported file type.' WHEN 6 THEN 'The uploaded file is empty.'
         ELSE CASE WHEN size > 3000 THEN 'File exceeds the size limit.' WHEN k = 2 THEN 'The file does not look like a valid PDF.'
         WHEN k = 4 THEN 'The file is not a valid DOCX document.' WHEN k = 5 THEN 'Text files must not contain binary data.' END END AS error FROM s""")
def s03(t):
    kind = F.pmod(F.col("doc_id"), F.lit(9))
    raw = F.col("text").cast("binary")
    content = (
        F.when(kind == 1, F.concat(F.lit("%PDF-").cast("binary"), raw))
        .when(kind == 3, F.concat(F.unhex(F.lit("504B0304")), F.lit("word/document.xml").cast("binary"), raw))
        .when(kind == 5, F.concat(F.unhex(F.lit("00")), raw))
        .when(kind == 6, F.lit("").cast("binary"))
        .otherwise(raw)
    )
    ext = F.element_at(F.array(*map(F.lit, VARIANTS)), (kind + 1).cast("int"))
    made = t.spread("documents").select("doc_id", F.concat(F.lit("doc."), ext).alias("path"), content.alias("content"))
    return files.validate_files(made, max_bytes=3000).select("doc_id", "error")


@query("s04_dedup_by_checksum",
       """SELECT doc_id, sha256(text) AS checksum, min(doc_id) OVER (PARTITION BY text) AS keeper,
       min(doc_id) OVER (PARTITION BY text) <> doc_id AS duplicate FROM documents""")
def s04(t):
    return q.dedup_by_checksum(t.documents, "doc_id", "text")


@query("s05_file_names_and_titles",
       r"""WITH a AS (SELECT page_id, list_extract(string_split(regexp_replace(replace(url, '\', '/'), '(?:/+\.?)+$', ''), '/'), -1) AS base FROM pages),
       b AS (SELECT page_id, regexp_replace(regexp_replace(base, '[^\pL\pN_.\- ()\x{980}-\x{9ff}]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS safe FROM a),
       c AS (SELECT page_id, substr(CASE WHEN safe = '' THEN 'document' ELSE safe END, 1, 200) AS filename FROM b),
       d AS (SELECT *, list_filter(regexp_split_to_array(trim(translate(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), '_-', '  ')), '\s+'), lambda w: w <> '') AS w FROM c)
       SELECT page_id, filename, array_to_string(list_transform(w, lambda x: CASE WHEN x = lower(x) AND x <> upper(x) THEN upper(x[1]) || lower(x[2:]) ELSE x END), ' ') AS title FROM d""")
def s05(t):
    return t.pages.select("page_id", files.sanitize_filename(F.col("url")).alias("filename")).withColumn(
        "title", files.title_from_filename(F.col("filename")))


@query("s06_replace_document_chunks",
       """WITH target AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents),
       new AS (SELECT doc_id AS document_id, upper(text) AS content, 0 AS chunk_index FROM documents WHERE lang = 'fr')
       SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(content) AS content_md5 FROM target WHERE document_id NOT IN (SELECT document_id FROM new)
       UNION ALL SELECT document_id, chunk_index, md5(content) FROM new""")
def s06(t):
    target = t.documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    new = t.documents.filter("lang = 'fr'").select(
        F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.upper("text").alias("content"))
    table = ChunkTable(t.spark, new_folder(t.spark, "chunk-table"), "document_id bigint, chunk_index int, content string")
    table.replace(target)
    table.replace(new)
    return table.read().select("document_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("s07_result_page",
       """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 200 AS truncated
       FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def s07(t):
    asked = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return q.result_page(asked, 200, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("s08_json_safe", v(
    """SELECT o.o_orderkey, round(o.o_totalprice / 7, 6) AS share, CAST(o.o_totalprice AS DOUBLE) AS amount, CAST(o.o_totalprice AS DECIMAL(14,0))::BIGINT AS whole,
    strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed, strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS placed_zoned,
    CAST(o.o_orderkey::DECIMAL(18,0) * 100000000000000000000::DECIMAL(21,0) AS VARCHAR) AS huge, strftime(o.o_orderdate, '%Y-%m-%d') AS day, '<binary>' AS raw, o.o_orderstatus = 'F' AS done
    FROM orders o"""))
def s08(t):
    typed = t.orders.select(
        "o_orderkey", (F.col("o_totalprice") / 7).alias("share"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
        F.col("o_totalprice").cast("decimal(14,0)").alias("whole"), F.col("o_orderdate").alias("placed"), F.col("o_orderdate").cast("timestamp").alias("placed_zoned"),
        (F.col("o_orderkey").cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)")).cast("decimal(38,0)").alias("huge"),
        F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").cast("binary").alias("raw"), (F.col("o_orderstatus") == "F").alias("done"))
    return q.json_safe(typed).withColumn("huge", F.col("huge").cast("string"))


@query("s08b_event_times_as_iso",
       """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS ts FROM events""")
def s08b(t):
    return q.json_safe(t.events.select("event_id", "ts"))


@query("s09_eval_items_and_report",
       """SELECT CASE WHEN turn % 2 = 0 THEN 'sql' ELSE 'rag' END AS category, count(*) AS items, count(*) FILTER (WHERE turn % 2 = 0) AS with_gold,
       CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(turn % 3) AS BIGINT) AS sources FROM conversations WHERE role = 'user' GROUP BY 1""")
def s09(t):
    """User messages written as an item file, read back with the item schema, and reported on."""
    folder, even = new_folder(t.spark, "items"), F.col("turn") % 2 == 0
    items = t.conversations.filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(even, "sql").otherwise("rag").alias("category"), F.col("text").alias("question"),
        F.when(even, "SELECT 1").alias("gold_sql"), F.slice(F.array(F.lit("a.md"), F.lit("b.md")), 1, (F.col("turn") % 3).cast("int")).alias("expected_sources"))
    items.write.json(f"{folder}/items")
    report = evaluation.read_eval_items(t.spark, f"{folder}/items").groupBy("category").agg(
        F.count("*").alias("items"), F.count("gold_sql").alias("with_gold"), F.sum(F.length("question")).alias("characters"),
        F.sum(F.size("expected_sources")).alias("sources"))
    evaluation.write_report(report, f"{folder}/report")
    return t.spark.read.schema(report.schema).json(f"{folder}/report")


@query("s10_snapshot",
       """SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def s10(t):
    """A snapshot partitioned by status; the filter on it skips whole folders."""
    folder = new_folder(t.spark, "snapshot")
    snapshots.write_snapshot(t.orders.withColumnRenamed("o_orderstatus", "status"), folder, ["status"])
    return t.spark.read.parquet(folder).filter("status <> 'P'").groupBy("status").agg(
        F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"))


def bucketed_snapshots(t, buckets: int = 8):
    """Snapshots of the orders and the customers, both bucketed by customer."""
    base = new_folder(t.spark, "bucketed")
    name = base.rsplit("/", 1)[-1].replace("-", "_")
    tables = ("orders", t.orders.withColumnRenamed("o_custkey", "custkey")), ("customers", t.customer.withColumnRenamed("c_custkey", "custkey"))
    return [snapshots.write_bucketed(df, f"{name}_{kind}", "custkey", buckets, f"{base}/{kind}") for kind, df in tables]


@query("s10b_bucketed_snapshot",
       """SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total
       FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def s10b(t):
    """Snapshots that share their buckets are joined, and counted by customer, bucket by bucket."""
    orders, customers = bucketed_snapshots(t)
    of_customer = orders.join(customers, "custkey").groupBy("custkey", "c_mktsegment").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("total"))
    return of_customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.sum("n").alias("orders"), F.count("*").alias("customers"), F.sum("total").cast("double").alias("total"))


def constraints(t):
    c, ref = t.commerce, q.References
    return [
        q.Unique("orders_pk", t.orders, ("o_orderkey",)),
        q.Unique("customer_pk", t.customer, ("c_custkey",)),
        q.Unique("part_pk", t.part, ("p_partkey",)),
        q.Unique("items_order_line", t.lineitem, ("l_orderkey", "l_linenumber")),
        q.Unique("inventory_product_warehouse", c.inventory(), ("product_id", "warehouse")),
        q.Unique("messages_pk", t.conversations, ("conv_id", "turn")),
        ref("items_order_fk", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        ref("items_product_fk", t.lineitem, "l_partkey", t.part, "p_partkey"),
        ref("orders_customer_fk", t.orders, "o_custkey", t.customer, "c_custkey"),
        ref("labels_document_fk", t.labels, "doc_id", t.documents, "doc_id"),
        ref("benchmark_label_fk", t.benchmark, "item_id", t.labels, "doc_id"),
        q.Check("quantity_positive", t.lineitem, F.col("l_quantity") > 0),
        q.Check("quantity_range", t.lineitem, F.col("l_quantity").between(1, 40)),
        q.Check("return_flag_vocabulary", t.lineitem, F.col("l_returnflag").isin("A", "R")),
        q.Check("line_status_vocabulary", t.lineitem, F.col("l_linestatus").isin("F", "O")),
        q.Check("order_status_known", t.orders, F.col("o_orderstatus").isin(*ORDER_STATUS)),
        q.Check("order_status_closed", t.orders, F.col("o_orderstatus").isin("F", "P")),
        q.Check("payment_status_vocabulary", c.payments(), F.col("status").isin("completed", "pending", "refunded")),
        q.Check("balance_not_negative", t.customer, F.col("c_acctbal") >= 0),
    ]


def _unique(name, table, columns):
    return f"SELECT '{name}' AS \"constraint\", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM {table} GROUP BY {columns})"


def _ref(name, child, column, parent, key):
    return f"SELECT '{name}', count(*) FROM {child} WHERE {column} NOT IN (SELECT {key} FROM {parent})"


def _check(name, table, condition):
    return f"SELECT '{name}', count(*) FROM {table} WHERE NOT ({condition})"


@query("s11_constraint_violations", v(" UNION ALL ".join([
    _unique("orders_pk", "orders", "o_orderkey"), _unique("customer_pk", "customer", "c_custkey"),
    _unique("part_pk", "part", "p_partkey"), _unique("items_order_line", "lineitem", "l_orderkey, l_linenumber"),
    _unique("inventory_product_warehouse", "v_inventory", "product_id, warehouse"), _unique("messages_pk", "conversations", "conv_id, turn"),
    _ref("items_order_fk", "lineitem", "l_orderkey", "orders", "o_orderkey"), _ref("items_product_fk", "lineitem", "l_partkey", "part", "p_partkey"),
    _ref("orders_customer_fk", "orders", "o_custkey", "customer", "c_custkey"), _ref("labels_document_fk", "labels", "doc_id", "documents", "doc_id"),
    _ref("benchmark_label_fk", "benchmark", "item_id", "labels", "doc_id"),
    _check("quantity_positive", "lineitem", "l_quantity > 0"), _check("quantity_range", "lineitem", "l_quantity BETWEEN 1 AND 40"), _check("return_flag_vocabulary", "lineitem", "l_returnflag IN ('A', 'R')"),
    _check("line_status_vocabulary", "lineitem", "l_linestatus IN ('F', 'O')"), _check("order_status_known", "orders", "o_orderstatus IN ('F', 'O', 'P')"),
    _check("order_status_closed", "orders", "o_orderstatus IN ('F', 'P')"),
    _check("payment_status_vocabulary", "v_payments", "status IN ('completed', 'pending', 'refunded')"),
    _check("balance_not_negative", "customer", "c_acctbal >= 0")])))
def s11(t):
    return q.check_constraints(constraints(t))


@query("s12_money_rules", v(
    """WITH items AS (SELECT order_id, sum(line_total) AS subtotal, count(*) AS n FROM v_items GROUP BY 1)
    SELECT 'line_total' AS rule, count(*) AS violations FROM v_items WHERE abs(unit_price * quantity - discount_amount - line_total) > 0.01
    UNION ALL SELECT 'order_total', count(*) FROM v_orders JOIN items USING (order_id) WHERE abs(subtotal - total_amount) > 0.01
    UNION ALL SELECT 'revenue_identity', CASE WHEN (SELECT sum(line_total) FROM v_items) = (SELECT sum(subtotal) FROM items) THEN 0 ELSE 1 END"""))
def s12(t):
    """Line, order and grand totals must agree (within a cent); the test data breaks the first two."""
    c = t.commerce
    items = c.order_items()
    line_gap = F.abs(F.col("unit_price") * F.col("quantity") - F.col("discount_amount") - F.col("line_total"))
    per_order = items.groupBy("order_id").agg(F.sum("line_total").alias("subtotal"))
    orders = c.orders().join(per_order, "order_id")
    lines = items.agg(F.count_if(line_gap > 0.01).alias("violations")).select(F.lit("line_total").alias("rule"), "violations")
    totals = orders.agg(F.count_if(F.abs(F.col("subtotal") - F.col("total_amount")) > 0.01).alias("violations")).select(
        F.lit("order_total").alias("rule"), "violations")
    sums = items.agg(F.sum("line_total").alias("s")).unionByName(per_order.agg(F.sum("subtotal").alias("s")))
    identity = sums.agg((F.countDistinct("s") - 1).alias("violations")).select(F.lit("revenue_identity").alias("rule"), "violations")
    return lines.unionByName(totals).unionByName(identity)


def _profile_sql() -> str:
    parts = []
    for table, schema in SCHEMAS.items():
        columns = [c.strip().split(" ", 1) for c in schema.split(",")]
        for i, (name, kind) in enumerate(columns):
            parts.append(
                f"SELECT '{table}' AS \"table\", count(*) AS row_count, {len(columns)} AS column_count, {i + 1} AS position, '{name}' AS \"column\", "
                f"'{kind.strip()}' AS type, {name in ROW_KEYS.get(table, ())} AS is_key, CAST(NULL AS VARCHAR) AS description, "
                f"count(*) FILTER (WHERE {name} IS NULL) AS null_count FROM {table}")
    return " UNION ALL ".join(parts)


@query("s13_table_profiles", _profile_sql())
def s13(t):
    return q.profile_tables({name: getattr(t, name) for name in SCHEMAS}, ROW_KEYS)
