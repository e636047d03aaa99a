"""Metric rules over the business views.

Rules: revenue = sum(total_amount) of orders that are not cancelled; product, brand
or category revenue = sum(line_total), units = sum(quantity), both on such orders.
Relative periods are computed from ``as_of`` and become literal range filters, which
Spark pushes into the order scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.sources.commerce import ORDER_STATUS, STATUS_CODES

AS_OF = date(2001, 7, 15)

# Yearly spend that reaches a membership tier, and shipping fees.
TIERS = [(200_000, "Platinum"), (75_000, "Gold"), (25_000, "Silver"), (0, "Bronze")]
FOREIGN_FEE, FREE_FROM, CAPITAL_FEE, DOMESTIC_FEE = 1500, 3000, 60, 120


@dataclass(frozen=True)
class Period:
    """Half-open time range; an open end means "until now"."""

    start: date | None = None
    end: date | None = None

    def holds(self, column: str) -> Column:
        condition = F.lit(True)
        if self.start is not None:
            condition = F.col(column) >= _ntz(self.start)
        if self.end is not None:
            condition = condition & (F.col(column) < _ntz(self.end))
        return condition


def _ntz(day: date) -> Column:
    return F.lit(datetime(day.year, day.month, day.day).strftime("%Y-%m-%d")).cast("timestamp_ntz")


def _months_before(day: date, months: int) -> date:
    total = day.year * 12 + day.month - 1 - months
    year, month = divmod(total, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


ALL_TIME = Period()


def this_month(as_of: date = AS_OF) -> Period:
    return Period(as_of.replace(day=1))


def last_month(as_of: date = AS_OF) -> Period:
    first = as_of.replace(day=1)
    return Period(_months_before(first, 1), first)


def last_quarter(as_of: date = AS_OF) -> Period:
    first = date(as_of.year, (as_of.month - 1) // 3 * 3 + 1, 1)
    return Period(_months_before(first, 3), first)


def this_year(as_of: date = AS_OF) -> Period:
    return Period(date(as_of.year, 1, 1))


def last_year(as_of: date = AS_OF) -> Period:
    return Period(date(as_of.year - 1, 1, 1), date(as_of.year, 1, 1))


def last_days(days: int, as_of: date = AS_OF) -> Period:
    return Period(as_of - timedelta(days=days))


def last_months(months: int, as_of: date = AS_OF) -> Period:
    return Period(_months_before(as_of, months))


def live(orders: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    """Orders that count as sales in a period: of any known status but cancelled."""
    counted = [code for code, status in ORDER_STATUS.items() if status != "cancelled"]
    return orders.filter(F.col("status_code").isin(counted) & period.holds("order_date"))


def cancelled(orders: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    return orders.filter((F.col("status_code") == STATUS_CODES["cancelled"]) & period.holds("order_date"))


def as_amount(total: Column) -> Column:
    """Exact decimal total to a double with two digits."""
    return F.round(total, 2).cast("double")


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def revenue(orders: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    return live(orders, period).agg(as_amount(F.sum("total_amount")).alias("revenue"))


def sales_by_product(c, period: Period = ALL_TIME) -> DataFrame:
    """Units and revenue per product.

    The item scan is reduced by the surviving order keys first and aggregated to one
    row per product before any product attribute is joined."""
    sold = c.order_items().join(live(c.orders(), period).select("order_id"), "order_id", "left_semi")
    return sold.groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.sum("line_total").alias("revenue")
    )


def sales_by(c, attribute: str, period: Period = ALL_TIME) -> DataFrame:
    """Units and revenue per product attribute (name, brand or category)."""
    return (
        sales_by_product(c, period)
        .join(c.products().select("product_id", attribute), "product_id")
        .groupBy(attribute)
        .agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    )


def spend_by_customer(c, period: Period = ALL_TIME) -> DataFrame:
    return live(c.orders(), period).groupBy("customer_id").agg(F.sum("total_amount").alias("spend"))


def top_spenders(c, n: int, period: Period = ALL_TIME) -> DataFrame:
    """Names are looked up for the n winners only, not for every customer."""
    best = spend_by_customer(c, period).orderBy(F.desc("spend"), "customer_id").limit(n)
    return best.join(c.customers().select("customer_id", "full_name"), "customer_id").select(
        "full_name", as_amount(F.col("spend")).alias("spend")
    )


def most_frequent(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def membership(c, as_of: date = AS_OF) -> DataFrame:
    """Tier of every customer: spend of the last 365 days less refunds on those orders.

    Refunds are summed per order before they meet the orders, and customers without
    orders stay in (Bronze)."""
    refunds = c.returns().groupBy("order_id").agg(F.sum("refund_amount").alias("refunded"))
    net = (
        live(c.orders(), last_days(365, as_of))
        .join(refunds, "order_id", "left")
        .groupBy("customer_id")
        .agg((F.sum("total_amount") - F.sum(F.coalesce("refunded", F.lit(0).cast("decimal(14,2)")))).alias("spend"))
    )
    spend = F.coalesce(F.col("spend"), F.lit(0).cast("decimal(14,2)"))
    tier = F.lit(TIERS[-1][1])
    for limit, name in reversed(TIERS[:-1]):
        tier = F.when(spend >= limit, name).otherwise(tier)
    return (
        c.customers()
        .join(net, "customer_id", "left")
        .select("customer_id", "full_name", as_amount(spend).alias("spend"), tier.alias("tier"))
    )


def shipping_fee(country: Column, city: Column, subtotal: Column, home: str, capital: str) -> Column:
    return (
        F.when(country != home, FOREIGN_FEE)
        .when(subtotal >= FREE_FROM, 0)
        .when(city == capital, CAPITAL_FEE)
        .otherwise(DOMESTIC_FEE)
    )
