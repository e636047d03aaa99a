"""The commerce question set (Q01-Q45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import commerce as m
from quayside.plans.registry import query
from quayside.sources.commerce import with_views as v

HOME, CAPITAL = "ASIA", "NATION_2"
SOLD = """
  SELECT {label} AS label, CAST(sum(i.quantity) AS BIGINT) AS units, sum(i.line_total) AS revenue
  FROM v_items i JOIN v_orders o USING (order_id) JOIN v_products p USING (product_id)
  WHERE o.status <> 'cancelled' {period} GROUP BY {label}"""
THIS_YEAR = "AND o.order_date >= TIMESTAMP '2001-01-01'"


def sold(label: str, period: str = "") -> str:
    return SOLD.format(label=label, period=period)


@query("q01_orders_last_month", v(
    "SELECT count(*) AS orders FROM v_orders WHERE order_date >= TIMESTAMP '2001-06-01' AND order_date < TIMESTAMP '2001-07-01'"))
def q01(t):
    return m.count_rows(t.commerce.orders().filter(m.last_month().holds("order_date")), "orders")


@query("q02_revenue_last_30_days", v(
    "SELECT CAST(round(sum(total_amount), 2) AS DOUBLE) AS revenue FROM v_orders WHERE status <> 'cancelled' AND order_date >= TIMESTAMP '2001-06-15'"))
def q02(t):
    return m.revenue(t.commerce.orders(), m.last_days(30))


@query("q03_top_category_this_year", v(
    f"SELECT label AS category, CAST(round(revenue, 2) AS DOUBLE) AS revenue FROM ({sold('p.category', THIS_YEAR)}) ORDER BY revenue DESC, 1 LIMIT 1"))
def q03(t):
    best = m.sales_by(t.commerce, "category", m.this_year()).orderBy(F.desc("revenue"), "category").limit(1)
    return best.select("category", m.as_amount(F.col("revenue")).alias("revenue"))


@query("q04_top_products_by_units", v(
    f"SELECT label AS name, units FROM ({sold('p.name')}) ORDER BY units DESC, name LIMIT 5"))
def q04(t):
    return m.sales_by(t.commerce, "name").select("name", "units").orderBy(F.desc("units"), "name").limit(5)


TIER_SQL = """
WITH refunds AS (SELECT order_id, sum(refund_amount) AS refunded FROM v_returns GROUP BY 1),
net AS (SELECT customer_id, sum(total_amount) - sum(coalesce(refunded, 0)) AS spend
        FROM v_orders LEFT JOIN refunds USING (order_id)
        WHERE status <> 'cancelled' AND order_date >= TIMESTAMP '2001-07-15' - INTERVAL 365 DAY GROUP BY 1),
tiers AS (SELECT customer_id, full_name, CAST(round(coalesce(spend, 0), 2) AS DOUBLE) AS spend,
          CASE WHEN coalesce(spend, 0) >= 200000 THEN 'Platinum' WHEN coalesce(spend, 0) >= 75000 THEN 'Gold'
               WHEN coalesce(spend, 0) >= 25000 THEN 'Silver' ELSE 'Bronze' END AS tier
          FROM v_customers LEFT JOIN net USING (customer_id))
"""


@query("q05_customers_per_tier", v(TIER_SQL + "SELECT tier, count(*) AS customers FROM tiers GROUP BY tier"))
def q05(t):
    return m.membership(t.commerce).groupBy("tier").agg(F.count("*").alias("customers"))


@query("q06_top_customers_by_spend", v(
    """SELECT full_name, CAST(round(sum(total_amount), 2) AS DOUBLE) AS spend FROM v_orders JOIN v_customers USING (customer_id)
    WHERE status <> 'cancelled' GROUP BY customer_id, full_name ORDER BY sum(total_amount) DESC, customer_id LIMIT 5"""))
def q06(t):
    return m.top_spenders(t.commerce, 5)


@query("q07_average_order_value", v(
    "SELECT round(CAST(sum(total_amount) AS DOUBLE) / count(*), 2) AS average_order_value FROM v_orders WHERE status <> 'cancelled'"))
def q07(t):
    total = F.sum("total_amount").cast("double")
    return m.live(t.commerce.orders()).agg(F.round(total / F.count("*"), 2).alias("average_order_value"))


@query("q08_cancelled_this_year", v(
    "SELECT count(*) AS orders FROM v_orders WHERE status = 'cancelled' AND order_date >= TIMESTAMP '2001-01-01'"))
def q08(t):
    return m.count_rows(m.cancelled(t.commerce.orders(), m.this_year()), "orders")


@query("q09_top_completed_payment_method", v(
    "SELECT method, count(*) AS n FROM v_payments WHERE status = 'completed' GROUP BY method ORDER BY n DESC, method LIMIT 1"))
def q09(t):
    return m.most_frequent(t.commerce.payments().filter("status = 'completed'"), "method")


@query("q10_products_out_of_stock", v(
    "SELECT count(*) AS products FROM (SELECT product_id FROM v_inventory GROUP BY product_id HAVING sum(quantity_on_hand) = 0)"))
def q10(t):
    stock = t.commerce.inventory().groupBy("product_id").agg(F.sum("quantity_on_hand").alias("stock"))
    return m.count_rows(stock.filter("stock = 0"), "products")


@query("q11_stock_per_warehouse", v(
    "SELECT warehouse, CAST(sum(quantity_on_hand) AS BIGINT) AS stock FROM v_inventory GROUP BY warehouse"))
def q11(t):
    return t.commerce.inventory().groupBy("warehouse").agg(F.sum("quantity_on_hand").alias("stock"))


@query("q12_returns_last_month", v(
    "SELECT count(*) AS returns FROM v_returns WHERE requested_at >= TIMESTAMP '2001-06-01' AND requested_at < TIMESTAMP '2001-07-01'"))
def q12(t):
    return m.count_rows(t.commerce.returns().filter(m.last_month().holds("requested_at")), "returns")


@query("q13_top_return_reason", v(
    "SELECT reason, count(*) AS n FROM v_returns GROUP BY reason ORDER BY n DESC, reason LIMIT 1"))
def q13(t):
    return m.most_frequent(t.commerce.returns(), "reason")


@query("q14_best_rated_product", v(
    """SELECT p.name, round(avg(r.rating), 6) AS average_rating, count(*) AS reviews FROM v_reviews r JOIN v_products p USING (product_id)
    GROUP BY product_id, p.name HAVING count(*) >= 3 ORDER BY avg(r.rating) DESC, count(*) DESC, p.name, product_id LIMIT 1"""))
def q14(t):
    rated = t.commerce.reviews().groupBy("product_id").agg(F.avg("rating").alias("avg"), F.count("*").alias("reviews"))
    named = rated.filter("reviews >= 3").join(t.commerce.products().select("product_id", "name"), "product_id")
    return named.orderBy(F.desc("avg"), F.desc("reviews"), "name", "product_id").limit(1).select(
        "name", F.round("avg", 6).alias("average_rating"), "reviews")


@query("q15_orders_per_channel", v("SELECT channel, count(*) AS orders FROM v_orders GROUP BY channel"))
def q15(t):
    return t.commerce.orders().groupBy("channel").agg(F.count("*").alias("orders"))


@query("q16_refunds_this_year", v(
    "SELECT CAST(round(sum(refund_amount), 2) AS DOUBLE) AS refunded FROM v_returns WHERE status = 'refunded' AND resolved_at >= TIMESTAMP '2001-01-01'"))
def q16(t):
    done = t.commerce.returns().filter((F.col("status") == "refunded") & m.this_year().holds("resolved_at"))
    return done.agg(m.as_amount(F.sum("refund_amount")).alias("refunded"))


@query("q17_city_with_most_customers", v(
    "SELECT city, count(*) AS n FROM v_customers GROUP BY city ORDER BY n DESC, city LIMIT 1"))
def q17(t):
    return m.most_frequent(t.commerce.customers(), "city")


@query("q18_foreign_orders", v(f"SELECT count(*) AS orders FROM v_shipped WHERE shipping_country <> '{HOME}'"))
def q18(t):
    return m.count_rows(t.commerce.shipped_orders().filter(F.col("shipping_country") != HOME), "orders")


@query("q19_active_customers_this_year", v(
    "SELECT count(DISTINCT customer_id) AS customers FROM v_orders WHERE order_date >= TIMESTAMP '2001-01-01'"))
def q19(t):
    return t.commerce.orders().filter(m.this_year().holds("order_date")).agg(F.countDistinct("customer_id").alias("customers"))


@query("q20_top_brand_last_quarter", v(
    f"""SELECT label AS brand, units FROM ({sold('p.brand', "AND o.order_date >= TIMESTAMP '2001-04-01' AND o.order_date < TIMESTAMP '2001-07-01'")})
    ORDER BY units DESC, brand LIMIT 1"""))
def q20(t):
    return m.sales_by(t.commerce, "brand", m.last_quarter()).select("brand", "units").orderBy(F.desc("units"), "brand").limit(1)


@query("q21_most_returned_product", v(
    """SELECT p.name, count(*) AS returns FROM v_returns JOIN v_products p USING (product_id)
    GROUP BY product_id, p.name ORDER BY returns DESC, p.name, product_id LIMIT 1"""))
def q21(t):
    counted = t.commerce.returns().groupBy("product_id").agg(F.count("*").alias("returns"))
    return (counted.join(t.commerce.products().select("product_id", "name"), "product_id")
            .orderBy(F.desc("returns"), "name", "product_id").limit(1).select("name", "returns"))


@query("q22_top_spender_this_year", v(
    """SELECT full_name, CAST(round(sum(total_amount), 2) AS DOUBLE) AS spend FROM v_orders o JOIN v_customers USING (customer_id)
    WHERE status <> 'cancelled' AND order_date >= TIMESTAMP '2001-01-01' GROUP BY customer_id, full_name
    ORDER BY sum(total_amount) DESC, customer_id LIMIT 1"""))
def q22(t):
    return m.top_spenders(t.commerce, 1, m.this_year())


@query("q23_top_category_last_3_months", v(
    f"""SELECT label AS category, CAST(round(revenue, 2) AS DOUBLE) AS revenue
    FROM ({sold('p.category', "AND o.order_date >= TIMESTAMP '2001-04-15'")}) ORDER BY revenue DESC, category LIMIT 1"""))
def q23(t):
    best = m.sales_by(t.commerce, "category", m.last_months(3)).orderBy(F.desc("revenue"), "category").limit(1)
    return best.select("category", m.as_amount(F.col("revenue")).alias("revenue"))


@query("q24_platinum_customers", v(TIER_SQL + "SELECT count(*) AS customers FROM tiers WHERE tier = 'Platinum'"))
def q24(t):
    return m.count_rows(m.membership(t.commerce).filter("tier = 'Platinum'"), "customers")


@query("q25_orders_paid_by_method", v(
    "SELECT count(DISTINCT order_id) AS orders FROM v_payments WHERE method = '1-URGENT'"))
def q25(t):
    return t.commerce.payments().filter("method = '1-URGENT'").agg(F.countDistinct("order_id").alias("orders"))


@query("q26_refunded_returns_this_year", v(
    "SELECT count(*) AS returns FROM v_returns WHERE status = 'refunded' AND resolved_at >= TIMESTAMP '2001-01-01'"))
def q26(t):
    return m.count_rows(t.commerce.returns().filter((F.col("status") == "refunded") & m.this_year().holds("resolved_at")), "returns")


def category_sales(t, category, period):
    """Sales of one category: its products are filtered before they meet the items."""
    wanted = t.commerce.products().filter(F.col("category") == category).select("product_id")
    return m.sales_by_product(t.commerce, period).join(wanted, "product_id", "left_semi")


@query("q27_category_revenue_this_year", v(
    f"SELECT CAST(round(revenue, 2) AS DOUBLE) AS revenue FROM ({sold('p.category', THIS_YEAR)}) WHERE label = 'PROMO'"))
def q27(t):
    return category_sales(t, "PROMO", m.this_year()).agg(m.as_amount(F.sum("revenue")).alias("revenue"))


@query("q28_category_units_last_month", v(
    f"""SELECT units FROM ({sold('p.category', "AND o.order_date >= TIMESTAMP '2001-06-01' AND o.order_date < TIMESTAMP '2001-07-01'")}) WHERE label = 'SMALL'"""))
def q28(t):
    return category_sales(t, "SMALL", m.last_month()).agg(F.sum("units").alias("units"))


@query("q29_customers_of_country", v("SELECT count(*) AS customers FROM v_customers WHERE country = 'ASIA'"))
def q29(t):
    return m.count_rows(t.commerce.customers().filter("country = 'ASIA'"), "customers")


def best_seller(t, period):
    return (m.sales_by_product(t.commerce, period)
            .join(t.commerce.products().select("product_id", "name"), "product_id")
            .orderBy(F.desc("units"), "name", "product_id").limit(1).select("name", "units"))


BEST_SELLER = """SELECT p.name, CAST(sum(i.quantity) AS BIGINT) AS units FROM v_items i JOIN v_orders o USING (order_id)
  JOIN v_products p USING (product_id) WHERE o.status <> 'cancelled' {period}
  GROUP BY product_id, p.name ORDER BY units DESC, p.name, product_id LIMIT 1"""


@query("q30_best_seller_last_year", v(BEST_SELLER.format(
    period="AND o.order_date >= TIMESTAMP '2000-01-01' AND o.order_date < TIMESTAMP '2001-01-01'")))
def q30(t):
    return best_seller(t, m.last_year())


@query("q31_best_seller_all_time", v(BEST_SELLER.format(period="")))
def q31(t):
    return best_seller(t, m.ALL_TIME)


@query("q32_warehouse_with_most_stock", v(
    "SELECT warehouse, CAST(sum(quantity_on_hand) AS BIGINT) AS stock FROM v_inventory GROUP BY warehouse ORDER BY stock DESC, warehouse LIMIT 1"))
def q32(t):
    return (t.commerce.inventory().groupBy("warehouse").agg(F.sum("quantity_on_hand").alias("stock"))
            .orderBy(F.desc("stock"), "warehouse").limit(1))


@query("q33_top_spender_all_time", v(
    """SELECT full_name, CAST(round(sum(total_amount), 2) AS DOUBLE) AS spend FROM v_orders JOIN v_customers USING (customer_id)
    WHERE status <> 'cancelled' GROUP BY customer_id, full_name ORDER BY sum(total_amount) DESC, customer_id LIMIT 1"""))
def q33(t):
    return m.top_spenders(t.commerce, 1)


@query("q34_sales_in_august", v(
    "SELECT CAST(round(sum(total_amount), 2) AS DOUBLE) AS revenue FROM v_orders WHERE status <> 'cancelled' AND month(order_date) = 8"))
def q34(t):
    return m.revenue(t.commerce.orders().filter(F.month("order_date") == 8))


@query("q35_cheapest_products_of_category", v(
    """SELECT product_id, name, CAST(price AS DOUBLE) AS price FROM v_products WHERE category = 'PROMO' ORDER BY price, name, product_id LIMIT 5"""))
def q35(t):
    return (t.commerce.products().filter("category = 'PROMO'").orderBy("price", "name", "product_id").limit(5)
            .select("product_id", "name", F.col("price").cast("double").alias("price")))


@query("q36_one_star_reviews", v("SELECT count(*) AS reviews FROM v_reviews WHERE rating = 1"))
def q36(t):
    return m.count_rows(t.commerce.reviews().filter("rating = 1"), "reviews")


@query("q37_customers_with_many_orders", v(
    """SELECT full_name, orders FROM (SELECT customer_id, count(*) AS orders FROM v_orders GROUP BY 1 HAVING count(*) > 10)
    JOIN v_customers USING (customer_id)"""))
def q37(t):
    busy = t.commerce.orders().groupBy("customer_id").agg(F.count("*").alias("orders")).filter("orders > 10")
    return busy.join(t.commerce.customers().select("customer_id", "full_name"), "customer_id").select("full_name", "orders")


@query("q38_failed_payment_share_this_month", v(
    """SELECT round(CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*), 6) AS failed_share, count(*) AS payments
    FROM v_payments WHERE created_at >= TIMESTAMP '2001-07-01'"""))
def q38(t):
    return t.commerce.payments().filter(m.this_month().holds("created_at")).agg(
        F.round(F.count_if(F.col("status") == "failed").cast("double") / F.count("*"), 6).alias("failed_share"),
        F.count("*").alias("payments"))


@query("q39a_cancelled_this_month", v(
    "SELECT count(*) AS orders FROM v_orders WHERE status = 'cancelled' AND order_date >= TIMESTAMP '2001-07-01'"))
def q39a(t):
    return m.count_rows(m.cancelled(t.commerce.orders(), m.this_month()), "orders")


@query("q39b_top_city_last_month", v(
    """SELECT shipping_city, count(*) AS n FROM v_shipped WHERE order_date >= TIMESTAMP '2001-06-01' AND order_date < TIMESTAMP '2001-07-01'
    GROUP BY 1 ORDER BY n DESC, shipping_city LIMIT 1"""))
def q39b(t):
    return m.most_frequent(t.commerce.shipped_orders().filter(m.last_month().holds("order_date")), "shipping_city")


@query("q39c_refund_money_and_count_this_year", v(
    """SELECT count(*) AS returns, CAST(round(sum(refund_amount), 2) AS DOUBLE) AS refunded FROM v_returns
    WHERE status = 'refunded' AND resolved_at >= TIMESTAMP '2001-01-01'"""))
def q39c(t):
    done = t.commerce.returns().filter((F.col("status") == "refunded") & m.this_year().holds("resolved_at"))
    return done.agg(F.count("*").alias("returns"), m.as_amount(F.sum("refund_amount")).alias("refunded"))


@query("q39d_foreign_orders_last_month", v(
    f"""SELECT count(*) AS orders FROM v_shipped WHERE shipping_country <> '{HOME}'
    AND order_date >= TIMESTAMP '2001-06-01' AND order_date < TIMESTAMP '2001-07-01'"""))
def q39d(t):
    foreign = t.commerce.shipped_orders().filter((F.col("shipping_country") != HOME) & m.last_month().holds("order_date"))
    return m.count_rows(foreign, "orders")


@query("q39e_top_product_of_category_this_year", v(
    """SELECT p.name, CAST(sum(i.quantity) AS BIGINT) AS units FROM v_items i JOIN v_orders o USING (order_id)
    JOIN v_products p USING (product_id) WHERE o.status <> 'cancelled' AND o.order_date >= TIMESTAMP '2001-01-01' AND p.category = 'LARGE'
    GROUP BY product_id, p.name ORDER BY units DESC, p.name, product_id LIMIT 1"""))
def q39e(t):
    wanted = t.commerce.products().filter("category = 'LARGE'").select("product_id", "name")
    return (m.sales_by_product(t.commerce, m.this_year()).join(wanted, "product_id")
            .orderBy(F.desc("units"), "name", "product_id").limit(1).select("name", "units"))


@query("q40_revenue_per_shipping_city", v(
    "SELECT shipping_city, CAST(round(sum(total_amount), 2) AS DOUBLE) AS revenue FROM v_shipped WHERE status <> 'cancelled' GROUP BY 1"))
def q40(t):
    """Orders are summed per customer before the customer's city is looked up."""
    place = t.commerce.customers().select("customer_id", F.col("city").alias("shipping_city"))
    return (m.spend_by_customer(t.commerce).join(place, "customer_id").groupBy("shipping_city")
            .agg(m.as_amount(F.sum("spend")).alias("revenue")))


@query("q41_membership_tiers", v(TIER_SQL + "SELECT customer_id, full_name, spend, tier FROM tiers"))
def q41(t):
    return m.membership(t.commerce)


@query("q42_shipping_fee_per_order", v(
    f"""WITH subtotals AS (SELECT order_id, sum(line_total) AS subtotal FROM v_items GROUP BY 1)
    SELECT order_id, CASE WHEN shipping_country <> '{HOME}' THEN 1500 WHEN coalesce(subtotal, 0) >= 3000 THEN 0
       WHEN shipping_city = '{CAPITAL}' THEN 60 ELSE 120 END AS shipping_fee
    FROM v_shipped LEFT JOIN subtotals USING (order_id)"""))
def q42(t):
    subtotal = t.commerce.order_items().groupBy("order_id").agg(F.sum("line_total").alias("subtotal"))
    fee = m.shipping_fee(F.col("shipping_country"), F.col("shipping_city"),
                         F.coalesce("subtotal", F.lit(0)), HOME, CAPITAL)
    return t.commerce.shipped_orders().join(subtotal, "order_id", "left").select("order_id", fee.alias("shipping_fee"))


@query("q43_first_order_per_customer", v(
    "SELECT customer_id, strftime(min(order_date), '%Y-%m-%d') AS first_order FROM v_orders GROUP BY 1"))
def q43(t):
    return t.commerce.orders().groupBy("customer_id").agg(F.date_format(F.min("order_date"), "yyyy-MM-dd").alias("first_order"))


@query("q44_restock_list", v(
    """SELECT product_id, warehouse, quantity_on_hand, CAST(sum(quantity_on_hand) OVER (PARTITION BY product_id) AS BIGINT) AS product_stock
    FROM v_inventory QUALIFY quantity_on_hand < reorder_level"""))
def q44(t):
    """Stock lines below their reorder level, with the stock of the product in all warehouses."""
    stock = t.commerce.inventory()
    total = stock.groupBy("product_id").agg(F.sum("quantity_on_hand").alias("product_stock"))
    return stock.filter("quantity_on_hand < reorder_level").join(total, "product_id").select(
        "product_id", "warehouse", "quantity_on_hand", "product_stock")


@query("q45_return_rate_per_category", v(
    """WITH sold AS (SELECT p.category, count(*) AS items FROM v_items JOIN v_products p USING (product_id) GROUP BY 1),
    back AS (SELECT p.category, count(*) AS returns FROM v_returns JOIN v_products p USING (product_id) GROUP BY 1)
    SELECT category, items, coalesce(returns, 0) AS returns, round(CAST(coalesce(returns, 0) AS DOUBLE) / items, 6) AS return_rate
    FROM sold LEFT JOIN back USING (category)"""))
def q45(t):
    """One pass over the items: a return is an item whose flag says so."""
    per_product = t.lineitem.groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returns"))
    return (per_product.join(t.commerce.products().select("product_id", "category"), "product_id")
            .groupBy("category").agg(F.sum("items").alias("items"), F.sum("returns").alias("returns"))
            .withColumn("return_rate", F.round(F.col("returns").cast("double") / F.col("items"), 6)))
