"""Chapter 1, sales and revenue.

Rows are joined on order_id first and combined there: the join leaves an
order's rows together, so sums per order need no further shuffle, and a count of
those sums is the count of distinct orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import big, round_half_up, rounded_ratio, year_month
from tradelens.operators.common import FULFILLED, dealt_by, is_fulfilled, reviews_per_order


def _month(col: str = "purchase_time"):
    return year_month(col)


# R01
def merged_orders_payments(orders: DataFrame, payments: DataFrame,
                           statuses=FULFILLED) -> DataFrame:
    """One row per payment line of a fulfilled order."""
    return (orders.where(is_fulfilled(statuses))
            .select("order_id", "customer_id", "order_status", "purchase_time")
            .join(payments.select("order_id", "payment_type", "payment_installments",
                                  "payment_value"), "order_id"))


def _revenue_aggs(avg_name: str):
    """Over rows (order, value): one row per distinct order of the group."""
    n = F.count(F.lit(1))
    return [
        round_half_up(F.sum("value"), 2).alias("total_revenue"),
        big(n).alias("total_orders"),
        rounded_ratio(F.sum("value"), n, scales=(2, 0)).alias(avg_name),
    ]


# R02 -- the reference repeats the status filter here; R01 already applied it.
def monthly_orders_revenue_summary(merged: DataFrame) -> DataFrame:
    per_order = (merged.groupBy("order_id", _month().alias("month"))
                 .agg(F.sum("payment_value").alias("value")))
    return (per_order.groupBy("month").agg(*_revenue_aggs("avg_revenue_per_order"))
            .orderBy("month"))


def ordered_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Item rows with their orders' status and purchase time: the one shuffle of the items. A
    batch writes it once for all reports that take it (``sold``)."""
    return (dealt_by(items.select("order_id", "product_id", "seller_id", "price"), "order_id")
            .join(orders.select("order_id", "order_status", "purchase_time"), "order_id"))


def _english(products: DataFrame, translation: DataFrame) -> DataFrame:
    # Inner join on purpose: items without product metadata or without an
    # English category name are not part of these two reports.
    return (products.select("product_id", "product_category_name")
            .join(translation.select("product_category_name",
                                     F.col("product_category_name_english").alias("category")),
                  "product_category_name"))


# R03
def monthly_category_revenue(items: DataFrame, products: DataFrame, translation: DataFrame,
                             orders: DataFrame, statuses=FULFILLED) -> DataFrame:
    return monthly_category_revenue_of(ordered_items(items, orders), products, translation, statuses)


def monthly_category_revenue_of(sold: DataFrame, products: DataFrame, translation: DataFrame,
                                statuses=FULFILLED) -> DataFrame:
    per_product = (sold.where(is_fulfilled(statuses))
                   .groupBy(_month().alias("month"), "product_id")
                   .agg(F.sum("price").alias("revenue")))
    return (per_product.join(_english(products, translation), "product_id")
            .groupBy("month", "category")
            .agg(round_half_up(F.sum("revenue"), 2).alias("total_revenue"))
            .orderBy("month", F.desc("total_revenue"), "category"))


# R04
def category_sales_summary(items: DataFrame, products: DataFrame, translation: DataFrame,
                           orders: DataFrame, statuses=FULFILLED) -> DataFrame:
    return category_sales_summary_of(ordered_items(items, orders), products, translation, statuses)


def category_sales_summary_of(sold: DataFrame, products: DataFrame, translation: DataFrame,
                              statuses=FULFILLED) -> DataFrame:
    per_product = (sold.where(is_fulfilled(statuses)).groupBy("product_id")
                   .agg(F.sum("price").alias("revenue"), F.count(F.lit(1)).alias("n")))
    return (per_product.join(_english(products, translation), "product_id")
            .groupBy("category")
            .agg(round_half_up(F.sum("revenue"), 2).alias("total_revenue"),
                 big(F.sum("n")).alias("total_items_sold"))
            .orderBy(F.desc("total_revenue"), "category"))


def paid_by_place(orders: DataFrame, payments: DataFrame, customers: DataFrame, statuses,
                   *place: str) -> DataFrame:
    """Payments per order and place; the last join is on order_id, so the
    aggregate needs no shuffle."""
    return (orders.where(is_fulfilled(statuses)).select("order_id", "customer_id")
            .join(customers.select("customer_id", *place), "customer_id")
            .join(payments.select("order_id", "payment_value"), "order_id")
            .groupBy("order_id", *place).agg(F.sum("payment_value").alias("value")))


# R05
def state_city_revenue(orders: DataFrame, payments: DataFrame, customers: DataFrame,
                       statuses=FULFILLED) -> DataFrame:
    place = ["customer_state", "customer_city"]
    return (paid_by_place(orders, payments, customers, statuses, *place)
            .groupBy(*place).agg(*_revenue_aggs("avg_revenue_per_order"))
            .orderBy(F.desc("total_revenue"), *place))


# R06 -- recounts distinct orders per state (R05's averages do not roll up).
def state_revenue_summary(orders: DataFrame, payments: DataFrame, customers: DataFrame,
                          statuses=FULFILLED) -> DataFrame:
    return (paid_by_place(orders, payments, customers, statuses, "customer_state")
            .groupBy("customer_state").agg(*_revenue_aggs("avg_order_value"))
            .orderBy(F.desc("total_revenue"), "customer_state"))


def _seller_orders(sold: DataFrame, statuses) -> DataFrame:
    """(order_id, seller_id) -> value, n_items over fulfilled orders, combined
    where the join on order_id left the rows."""
    return (sold.where(is_fulfilled(statuses)).groupBy("order_id", "seller_id")
            .agg(F.sum("price").alias("value"), F.count(F.lit(1)).alias("n_items")))


# R07
def seller_total_revenue(items: DataFrame, orders: DataFrame, statuses=FULFILLED) -> DataFrame:
    return seller_total_revenue_of(ordered_items(items, orders), statuses)


def seller_total_revenue_of(sold: DataFrame, statuses=FULFILLED) -> DataFrame:
    return (_seller_orders(sold, statuses)
            .groupBy("seller_id").agg(*_revenue_aggs("avg_revenue_per_order"))
            .orderBy(F.desc("total_revenue"), "seller_id"))


# R08 -- the reference LEFT joins item rows to review rows: an item's price is
# counted once per review row of its order (once if it has none), AVG skips
# NULL scores and reviews are counted as distinct ids. Reviews are combined per
# order, so the left join stays at one row per (order, seller); only the
# distinct review ids need rows of their own, which a union adds ahead of the one
# aggregate per seller. The always-true "score IS NOT NULL OR score IS NULL"
# filter is dropped.
def seller_revenue_review_summary(items: DataFrame, orders: DataFrame, reviews: DataFrame,
                                  statuses=FULFILLED) -> DataFrame:
    return seller_revenue_review_summary_of(ordered_items(items, orders), reviews, statuses)


def seller_revenue_review_summary_of(sold: DataFrame, reviews: DataFrame, statuses=FULFILLED) -> DataFrame:
    pairs = _seller_orders(sold, statuses)
    rows = pairs.join(reviews_per_order(reviews), "order_id", "left")
    times = F.greatest(F.coalesce("review_rows", F.lit(1)), F.lit(1))
    money = rows.select("seller_id", (F.col("value") * times).alias("value"), F.lit(1).alias("orders"),
                        (F.col("n_items") * F.col("score_sum")).alias("scores"),
                        (F.col("n_items") * F.col("scored")).alias("scored"))
    ids = (pairs.select("order_id", "seller_id")
           .join(reviews.where(F.col("review_id").isNotNull()).select("order_id", "review_id"), "order_id")
           .select("seller_id", "review_id").distinct()
           .select("seller_id", F.lit(1).alias("reviews")))
    both = money.unionByName(ids, allowMissingColumns=True)
    return (both.groupBy("seller_id")
            .agg(round_half_up(F.sum("value"), 2).alias("total_revenue"),
                 big(F.sum("orders")).alias("total_orders"),
                 rounded_ratio(F.sum("value"), F.sum("orders"), scales=(2, 0)).alias("avg_revenue_per_order"),
                 rounded_ratio(F.sum("scores"), F.sum("scored"), scales=(0, 0)).alias("avg_review_score"),
                 big(F.coalesce(F.sum("reviews"), F.lit(0))).alias("review_count"))
            .orderBy(F.desc("total_revenue"), "seller_id"))
