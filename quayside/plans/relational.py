"""One query per form of the general relational surface (G01-G18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import commerce as m
from quayside.operators.ranking import percentiles, with_rank
from quayside.plans.registry import query
from quayside.sources.commerce import with_views as v


@query("g01_projection_computed_column",
       "SELECT p_partkey AS part_id, p_name AS name, p_retailprice * 1.1 AS price_with_tax, p_size + 1 AS next_size FROM part")
def g01(t):
    return t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"),
                         (F.col("p_retailprice") * 1.1).alias("price_with_tax"), (F.col("p_size") + 1).alias("next_size"))


@query("g02_predicates",
       """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 300000
       AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey <> 1 AND o_orderdate > TIMESTAMP '1997-01-01'""")
def g02(t):
    return t.orders.filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 1000) & (F.col("o_totalprice") < 300000)
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_custkey") != 1)
        & (F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_totalprice")


@query("g03_inner_joins",
       """SELECT n_name, r_name, count(*) AS orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(14,2))), 2) AS DOUBLE) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def g03(t):
    """Orders shrink to one row per customer before the dimension joins."""
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("s"))
    return (per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("n_name", "r_name").agg(F.sum("n").alias("orders"), m.as_amount(F.sum("s")).alias("total")))


@query("g04_in_subquery",
       "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def g04(t):
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("g05_left_join",
       """SELECT c_custkey, coalesce(n, 0) AS urgent_orders FROM customer LEFT JOIN
       (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""")
def g05(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("urgent_orders"))


@query("g06a_unnest_with_ordinality",
       """SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (
       SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos""")
def g06a(t):
    return (t.embeddings.select(F.posexplode("embedding").alias("p", "x")).groupBy((F.col("p") + 1).alias("pos"))
            .agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")))


@query("g06b_unnest_parallel_arrays",
       """SELECT word, attribute, count(*) AS n FROM (
       SELECT unnest(string_split(p_name, ' ')) AS word, unnest([p_brand, p_type]) AS attribute FROM part) GROUP BY ALL""")
def g06b(t):
    pairs = F.arrays_zip(F.split("p_name", " ").alias("word"), F.array("p_brand", "p_type").alias("attribute"))
    return (t.part.select(F.explode(pairs).alias("x")).select("x.word", "x.attribute")
            .groupBy("word", "attribute").agg(F.count("*").alias("n")))


@query("g07_ordered_array_aggregate",
       """SELECT r_name, array_to_string(list(n_name ORDER BY n_nationkey), ', ') AS nations
       FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def g07(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name")
            .agg(F.array_join(ordered, ", ").alias("nations")))


@query("g08_common_table_expression",
       """WITH per_customer AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1),
       spread AS (SELECT orders, count(*) AS customers FROM per_customer GROUP BY 1) SELECT * FROM spread""")
def g08(t):
    per_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return per_customer.groupBy("orders").agg(F.count("*").alias("customers"))


@query("g09_aggregates_having",
       """SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers,
       CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*), 2) AS average
       FROM orders GROUP BY 1 HAVING count(*) > 100""")
def g09(t):
    total = F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), total.alias("total"),
        F.round(total / F.count("*"), 2).alias("average")).filter("orders > 100")


@query("g10_filtered_aggregate",
       """SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
       CAST(sum(CAST(value AS DECIMAL(14,2))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS purchased FROM events GROUP BY 1""")
def g10(t):
    bought = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(14,2)"))
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum(bought).cast("double").alias("purchased"))


@query("g11_continuous_percentile",
       "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def g11(t):
    row = percentiles(t.events, "value", {"p50": ("continuous", 0.5), "p95": ("continuous", 0.95)})
    return row.select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("g12_rank_over_whole_table",
       """WITH x AS (SELECT p_partkey, p_name, CASE p_partkey % 20 WHEN 7 THEN NULL WHEN 8 THEN 'nan'::DOUBLE WHEN 9 THEN -p_retailprice ELSE p_retailprice END AS price FROM part)
       SELECT p_partkey, p_name, rank() OVER (ORDER BY price DESC NULLS LAST) AS price_rank FROM x""")
def g12(t):
    """Prices of which some are made null, NaN or negative."""
    kind = F.pmod("p_partkey", F.lit(20))
    price = F.when(kind == 7, F.lit(None)).when(kind == 8, F.lit(float("nan"))).when(kind == 9, -F.col("p_retailprice")).otherwise(F.col("p_retailprice"))
    return with_rank(t.part.select("p_partkey", "p_name", price.alias("price")), "price", "price_rank").drop("price")


@query("g12b_rank_per_group",
       """SELECT p_partkey, rank() OVER (PARTITION BY CASE WHEN p_partkey % 10 <> 3 THEN p_brand END, p_type, p_size ORDER BY p_retailprice DESC) AS price_rank FROM part""")
def g12b(t):
    """Some brands are unknown: they are a group too."""
    keys = ["brand", "p_type", "p_size"]
    known = F.when(F.pmod("p_partkey", F.lit(10)) != 3, F.col("p_brand")).alias("brand")
    return with_rank(t.part.select("p_partkey", "p_retailprice", known, "p_type", "p_size"), "p_retailprice", "price_rank", keys).select(
        "p_partkey", "price_rank")


@query("g13_top_k_with_offset",
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def g13(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)


@query("g14a_union_distinct",
       "SELECT c_nationkey AS nation_id FROM customer UNION SELECT s_nationkey FROM supplier")
def g14a(t):
    return t.customer.select(F.col("c_nationkey").alias("nation_id")).union(t.supplier.select("s_nationkey")).distinct()


@query("g14b_intersect",
       "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def g14b(t):
    part = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return part("F").intersect(part("P"))


@query("g14c_except",
       "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def g14c(t):
    spenders = t.orders.filter("o_totalprice > 300000").select("o_custkey")
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(spenders)


@query("g15_dates_and_intervals",
       """SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
       strftime(date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH, '%Y-%m-%d') AS previous_quarter,
       strftime(date_trunc('year', o_orderdate) - INTERVAL 1 YEAR, '%Y-%m-%d') AS previous_year, count(*) AS orders
       FROM orders GROUP BY ALL""")
def g15(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    trunc = lambda unit: F.date_trunc(unit, "o_orderdate")
    return t.orders.groupBy(
        F.year("o_orderdate").cast("bigint").alias("y"), F.quarter("o_orderdate").cast("bigint").alias("q"),
        day(trunc("month")).alias("month_start"),
        day(F.add_months(trunc("quarter"), -3)).alias("previous_quarter"),
        day(F.add_months(trunc("year"), -12)).alias("previous_year"),
    ).agg(F.count("*").alias("orders"))


@query("g16_monthly_revenue", v(
    """SELECT strftime(date_trunc('month', order_date), '%Y-%m') AS month, CAST(round(sum(total_amount), 2) AS DOUBLE) AS revenue
    FROM v_orders WHERE status <> 'cancelled' GROUP BY 1"""))
def g16(t):
    return (m.live(t.commerce.orders()).groupBy(F.date_format("order_date", "yyyy-MM").alias("month"))
            .agg(m.as_amount(F.sum("total_amount")).alias("revenue")))


@query("g17_greatest_coalesce_concat",
       """SELECT c_custkey, greatest(c_acctbal, 0) AS credit, coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment,
       c_name || ' (' || c_mktsegment || ')' AS label FROM customer""")
def g17(t):
    return t.customer.select(
        "c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("credit"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("segment"),
        F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("label"))


@query("g18_null_filters", v(
    """SELECT route, count(*) AS runs FROM v_runs WHERE route IS NOT NULL GROUP BY route
    UNION ALL SELECT 'none', count(*) FROM v_runs WHERE route IS NULL"""))
def g18(t):
    runs = t.commerce.agent_runs()
    known = runs.filter(F.col("route").isNotNull()).groupBy("route").agg(F.count("*").alias("runs"))
    return known.unionByName(runs.filter(F.col("route").isNull()).agg(F.count("*").alias("runs")).withColumn("route", F.lit("none")))
