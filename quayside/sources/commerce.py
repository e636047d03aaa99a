"""Curated business views over the physical tables.

Columns are renamed, money becomes DECIMAL and derived facts (payments, stock,
returns, reviews) are computed, so the metric queries read like the business
schema. Everything is a narrow DataFrame expression: Catalyst sees through the
views and pushes filters and column pruning down to the Parquet scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"

# Vocabularies of the business schema.
ORDER_STATUS = {"F": "delivered", "O": "shipped", "P": "cancelled"}
STATUS_CODES = {status: code for code, status in ORDER_STATUS.items()}
RETURN_REASONS = ["defective", "damaged_in_transit", "wrong_item", "not_as_described", "size_issue", "changed_mind"]
REORDER_LEVEL = 20


def money(value: Column) -> Column:
    return value.cast(MONEY)


class Commerce:
    """The business schema; each method returns a fresh, lazy DataFrame."""

    def __init__(self, tables) -> None:
        self._t = tables

    def orders(self) -> DataFrame:
        status = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER_STATUS.items() for x in kv]), F.col("o_orderstatus"))
        return self._t.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            status.alias("status"),
            F.col("o_orderstatus").alias("status_code"),  # filters on the code itself reach the scan
            F.col("o_orderpriority").alias("channel"),
            money(F.col("o_totalprice")).alias("total_amount"),
        )

    def shipped_orders(self) -> DataFrame:
        """Orders with the city and country they are shipped to."""
        where = self.customers().select(
            "customer_id", F.col("city").alias("shipping_city"), F.col("country").alias("shipping_country")
        )
        return self.orders().join(where, "customer_id")

    def order_items(self) -> DataFrame:
        gross = money(F.col("l_extendedprice"))
        rate = F.col("l_discount").cast("decimal(4,2)")
        return self._t.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            # Half-up on whole cents, so that no binary rounding is involved.
            (F.expr("(cast(round(l_extendedprice * 100) as bigint) * 2 + cast(l_quantity as bigint))"
                    " div (2 * cast(l_quantity as bigint))").cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)"))
            .cast(MONEY).alias("unit_price"),
            F.round(gross * rate, 2).cast(MONEY).alias("discount_amount"),
            F.round(gross * (F.lit(1).cast("decimal(4,2)") - rate), 2).cast(MONEY).alias("line_total"),
        )

    def products(self) -> DataFrame:
        return self._t.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            money(F.col("p_retailprice")).alias("price"),
        )

    def customers(self) -> DataFrame:
        place = self._t.nation.join(
            self._t.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("country"))
        return self._t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("full_name"),
            "city",
            "country",
            F.col("c_mktsegment").alias("segment"),
        )

    def payments(self) -> DataFrame:
        status = F.col("status")
        return self.orders().select(
            "order_id",
            F.col("total_amount").alias("amount"),
            F.col("channel").alias("method"),
            F.when(status == "delivered", "completed")
            .when(status == "shipped", "pending")
            .when(F.col("order_id") % 2 == 0, "refunded")
            .otherwise("failed")
            .alias("status"),
            F.col("order_date").alias("created_at"),
        )

    def inventory(self) -> DataFrame:
        """Stock per product and warehouse (the supplier plays the warehouse)."""
        counted = F.when(F.col("l_linenumber") == 7, F.col("l_quantity").cast("bigint")).otherwise(0)
        return (
            self._t.lineitem.groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("warehouse"))
            .agg(F.sum(counted).alias("quantity_on_hand"))
            .withColumn("reorder_level", F.lit(REORDER_LEVEL))
        )

    def returns(self) -> DataFrame:
        refunded = F.col("l_linestatus") == "F"
        items = F.col("l_discount").cast("decimal(4,2)")
        total = F.round(money(F.col("l_extendedprice")) * (F.lit(1).cast("decimal(4,2)") - items), 2).cast(MONEY)
        reasons = F.array(*[F.lit(r) for r in RETURN_REASONS])
        return self._t.lineitem.filter("l_returnflag = 'R'").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.element_at(reasons, F.col("l_linenumber") % 6 + 1).alias("reason"),
            F.when(refunded, "refunded").otherwise("requested").alias("status"),
            F.when(refunded, total).otherwise(F.lit(0).cast(MONEY)).alias("refund_amount"),
            F.col("l_shipdate").alias("requested_at"),
            F.when(refunded, F.expr("l_shipdate + interval 3 days")).alias("resolved_at"),
        )

    def reviews(self) -> DataFrame:
        return self._t.lineitem.filter("l_returnflag = 'N'").select(
            F.col("l_partkey").alias("product_id"),
            ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int").alias("rating"),
        )

    def agent_runs(self) -> DataFrame:
        """Run log: one run per event, failed for 'error', latency from the value."""
        return self._t.events.select(
            F.col("event_id").alias("run_id"),
            "user_id",
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("route"),
            F.round(F.col("value") * 100).cast("bigint").alias("total_ms"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.col("ts").alias("created_at"),
        ).withColumn("trace", _trace())


def _trace() -> Column:
    """Stage timings of a run; the last stage carries the failure."""
    total = F.col("total_ms")
    first, second = F.floor(total / 5), F.floor(total / 3)

    def stage(name: str, duration: Column, status: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), duration.alias("duration_ms"), status.alias("status"))

    failed = F.when(F.col("status") == "failed", "error").otherwise("ok")
    return F.array(
        stage("routing", first, F.lit("ok")), stage("retrieval", second, F.lit("ok")),
        stage("answer_generation", total - first - second, failed))


# The same views for the DuckDB checks.
VIEWS_SQL = """
WITH v_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'cancelled' END AS status,
         o_orderpriority AS channel, CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount
  FROM orders),
v_customers AS (
  SELECT c_custkey AS customer_id, c_name AS full_name, n_name AS city, r_name AS country, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v_shipped AS (
  SELECT o.*, c.city AS shipping_city, c.country AS shipping_country
  FROM v_orders o JOIN v_customers c USING (customer_id)),
v_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) * 2 + CAST(l_quantity AS BIGINT))
           // (2 * CAST(l_quantity AS BIGINT))) / 100 AS DECIMAL(14,2)) AS unit_price,
         CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS discount_amount,
         CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(14,2)) AS line_total
  FROM lineitem),
v_products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category,
         CAST(p_retailprice AS DECIMAL(14,2)) AS price FROM part),
v_payments AS (
  SELECT order_id, total_amount AS amount, channel AS method,
         CASE WHEN status = 'delivered' THEN 'completed' WHEN status = 'shipped' THEN 'pending'
              WHEN order_id % 2 = 0 THEN 'refunded' ELSE 'failed' END AS status, order_date AS created_at
  FROM v_orders),
v_inventory AS (
  SELECT l_partkey AS product_id, l_suppkey AS warehouse,
         CAST(sum(CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS quantity_on_hand,
         20 AS reorder_level FROM lineitem GROUP BY l_partkey, l_suppkey),
v_returns AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         ['defective', 'damaged_in_transit', 'wrong_item', 'not_as_described', 'size_issue', 'changed_mind'][l_linenumber % 6 + 1] AS reason,
         CASE WHEN l_linestatus = 'F' THEN 'refunded' ELSE 'requested' END AS status,
         CASE WHEN l_linestatus = 'F' THEN CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(14,2)) ELSE 0 END AS refund_amount,
         l_shipdate AS requested_at,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 3 DAY END AS resolved_at
  FROM lineitem WHERE l_returnflag = 'R'),
v_reviews AS (
  SELECT l_partkey AS product_id, CAST((l_orderkey + l_linenumber) % 5 + 1 AS INTEGER) AS rating
  FROM lineitem WHERE l_returnflag = 'N'),
v_runs AS (
  SELECT event_id AS run_id, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN event_type <> 'error' THEN event_type END AS route,
         CAST(round(value * 100) AS BIGINT) AS total_ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS created_at
  FROM events)
"""


def with_views(sql: str) -> str:
    """SQL over the business views; a leading WITH continues the list of views."""
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return VIEWS_SQL.rstrip() + ",\n" + sql[5:]
    return VIEWS_SQL + sql
