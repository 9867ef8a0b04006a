"""Chapter 5, customers.

Loyalty is always measured on the person (customer_unique_id), never on the
per-checkout customer_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import big, mean_of, percent, rounded_ratio
from tradelens.operators.common import (
    items_per_order,
    more_than_one,
    order_persons,
    person_order_counts,
    reviews_per_order,
)

# ---------------------------------------------------------------------------
# Customer-type labels and the zip-report minimum.
# ---------------------------------------------------------------------------
ONE_TIME = "One-Time"
REPEAT = "Repeat"
ZIP_MIN_CUSTOMERS = 10


# R27 -- denominator: distinct persons in *customers*, including persons
# without any order; it is a scalar subquery, computed once by Spark.
def customer_order_frequency(customers: DataFrame, orders: DataFrame) -> DataFrame:
    persons = customers.agg(F.countDistinct("customer_unique_id")).scalar()
    g = (person_order_counts(customers, orders)
         .groupBy("total_orders").agg(F.count(F.lit(1)).alias("n")))
    return (g.select("total_orders", big("n").alias("customer_count"),
                     percent(F.col("n"), persons, scales=(0, 0)).alias("percentage_of_customers"))
            .orderBy("total_orders"))


# R28 -- order counts over all statuses; reviews with a score only. Scores are
# combined per order and carried by the one aggregate per person that also tells
# repeat buyers, so no rows are joined to an aggregate on the person.
def customer_type_review_summary(reviews: DataFrame, orders: DataFrame,
                                 customers: DataFrame) -> DataFrame:
    scored = reviews_per_order(reviews.where(F.col("review_score").isNotNull()))
    per_person = (order_persons(orders, customers)
                  .where(F.col("customer_unique_id").isNotNull())
                  .join(scored, "order_id", "left")
                  .groupBy("customer_unique_id")
                  .agg(more_than_one("order_id").alias("repeat"),
                       F.sum("score_sum").alias("scores"), F.sum("scored").alias("n"))
                  .where(F.col("n") > 0))
    kind = F.when(F.col("repeat"), REPEAT).otherwise(ONE_TIME)
    return (per_person.groupBy(kind.alias("customer_type"))
            .agg(rounded_ratio(F.sum("scores"), F.sum("n"), scales=(0, 0)).alias("avg_review_score"),
                 big(F.sum("n")).alias("review_count"))
            .orderBy("customer_type"))


# R29 building block, row level: the previous purchase of the same person.
def order_gaps(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """customer_unique_id, order_id, purchase_time, prev_purchase_time.

    LAG(purchase_time) over each person's orders by purchase time (NULL
    first, order_id breaking ties; a NULL person is one person), without
    putting a person's orders in one task: LAG runs per (person, calendar
    day), and a day's first order takes the last time of the person's day
    before, from a table of one row per (person, day). A person has at most as
    many such rows as the calendar has days, whatever the number of orders.
    """
    person, t = "customer_unique_id", F.col("purchase_time").asc_nulls_first()
    rows = (orders.select("order_id", "customer_id", "purchase_time")
            .join(customers.select("customer_id", person), "customer_id")
            .select(person, "order_id", "purchase_time", F.to_date("purchase_time").alias("day")))
    within = Window.partitionBy(person, "day").orderBy(t, "order_id")
    local = (rows.withColumn("nth", F.row_number().over(within))
             .withColumn("prev", F.lag("purchase_time").over(within)))
    days = rows.groupBy(person, "day").agg(F.max("purchase_time").alias("last"))
    days_in_order = Window.partitionBy(person).orderBy(F.col("day").asc_nulls_first())
    before = days.select(F.col(person).alias("p"), F.col("day").alias("d"),
                         F.lag("last").over(days_in_order).alias("before"))
    firsts = local.where(F.col("nth") == 1).join(
        before, F.col(person).eqNullSafe(F.col("p")) & F.col("day").eqNullSafe(F.col("d")), "left")
    return (firsts.select(person, "order_id", "purchase_time", F.col("before").alias("prev_purchase_time"))
            .unionByName(local.where(F.col("nth") > 1).select(
                person, "order_id", "purchase_time", F.col("prev").alias("prev_purchase_time"))))


def person_purchase_profile(orders: DataFrame, customers: DataFrame,
                            items: DataFrame) -> DataFrame:
    """customer_unique_id -> gap_count, gap_days, total_orders, total_spent for
    persons with at least one purchase gap and at least one order with items.

    Gaps: DATEDIFF counts calendar-date boundaries, so the gaps between
    consecutive purchases telescope -- their sum is DATEDIFF(last, first) and
    their number is (purchases with a time) - 1. This is the reference's
    LAG-then-aggregate as one aggregation with map-side partial min / max /
    count, instead of a window that gathers each person's orders in one task.

    Spend: items are summed per order first and joined to the same order rows,
    so orders x customers is joined once for both halves.
    """
    per_order = items_per_order(items).select("order_id", "item_rows", "price_sum")
    rows = (orders.select("order_id", "customer_id", "purchase_time")
            .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
            .join(per_order, "order_id", "left"))
    per_person = (rows.groupBy("customer_unique_id")
                  .agg(F.count("purchase_time").alias("n"),
                       F.min("purchase_time").alias("first"),
                       F.max("purchase_time").alias("last"),
                       F.countDistinct(F.when(F.col("item_rows").isNotNull(), F.col("order_id")))
                       .alias("orders_with_items"),
                       F.sum("price_sum").alias("total_spent")))
    # The reference joins the gap and spend summaries on the person, so a NULL
    # person never appears.
    return (per_person.where((F.col("n") > 1) & (F.col("orders_with_items") > 0)
                             & F.col("customer_unique_id").isNotNull())
            .select("customer_unique_id",
                    (F.col("n") - 1).alias("gap_count"),
                    F.datediff(F.col("last"), F.col("first")).alias("gap_days"),
                    big("orders_with_items").alias("total_orders"),
                    "total_spent"))


# R29 (reconstructed: the reference's final SELECT is missing) -- per person.
def repeat_customer_gaps(orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    return (person_purchase_profile(orders, customers, items)
            .select("customer_unique_id", "total_orders",
                    F.col("total_spent").cast("double").alias("total_spent"),
                    rounded_ratio(F.col("gap_days"), F.col("gap_count"), scales=(0, 0))
                    .alias("avg_days_between_orders")))


# R29 (reconstructed) -- by number of orders: average gap over all gaps,
# average spend over persons.
def repeat_customer_order_stats(orders: DataFrame, customers: DataFrame,
                                items: DataFrame) -> DataFrame:
    return (person_purchase_profile(orders, customers, items)
            .groupBy("total_orders")
            .agg(big(F.count(F.lit(1))).alias("customers"),
                 rounded_ratio(F.sum("gap_days"), F.sum("gap_count"), scales=(0, 0))
                 .alias("avg_days_between_orders"),
                 mean_of(F.sum("total_spent"), F.count("total_spent"), scale=2)
                 .alias("avg_total_spent"))
            .orderBy("total_orders"))


def _persons_and(customers: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    return (order_persons(orders, customers, key)
            .groupBy("customer_unique_id", key)
            .agg(more_than_one("order_id").alias("repeat")))


def _loyalty(rows: DataFrame, key: str, distinct_persons: bool) -> DataFrame:
    repeat = F.count_if("repeat")
    # Rows are unique per (person, key), so the reference's
    # COUNT(DISTINCT customer_unique_id) is COUNT(customer_unique_id) here (no
    # second distinct aggregation); the zip report counts rows, NULL person too.
    total = F.count("customer_unique_id") if distinct_persons else F.count(F.lit(1))
    return rows.groupBy(key).agg(big(total).alias("total_customers"),
                                 big(repeat).alias("repeat_customers"),
                                 percent(repeat, total, scales=(0, 0)).alias("loyalty_percent"))


# R30
def zip_loyalty_summary(customers: DataFrame, orders: DataFrame,
                        min_customers: int = ZIP_MIN_CUSTOMERS) -> DataFrame:
    key = "customer_zip_code_prefix"
    return (_loyalty(_persons_and(customers, orders, key), key, distinct_persons=False)
            .where(F.col("total_customers") >= min_customers)
            .orderBy(F.desc("loyalty_percent"), key))


# R31
def state_customer_loyalty(customers: DataFrame, orders: DataFrame) -> DataFrame:
    key = "customer_state"
    return (_loyalty(_persons_and(customers, orders, key), key, distinct_persons=True)
            .orderBy(key))


# R32 -- persons with more than one order anywhere; their scores by state. One
# aggregate per (person, state) carries the scores and the smallest and largest
# order id; a person's few state rows then tell whether there are two orders.
def state_repeat_review_scores(customers: DataFrame, orders: DataFrame,
                               reviews: DataFrame) -> DataFrame:
    person = "customer_unique_id"
    per_state = (order_persons(orders, customers, "customer_state")
                 .where(F.col(person).isNotNull())
                 .join(reviews_per_order(reviews), "order_id", "left")
                 .groupBy(person, "customer_state")
                 .agg(F.min("order_id").alias("lo"), F.max("order_id").alias("hi"),
                      F.sum("review_rows").alias("rows"), F.sum("score_sum").alias("scores"),
                      F.sum("scored").alias("n")))
    states = Window.partitionBy(person)
    repeaters = per_state.withColumn("two", F.min("lo").over(states) != F.max("hi").over(states))
    return (repeaters.where(F.col("two") & (F.col("rows") > 0))
            .groupBy("customer_state")
            .agg(rounded_ratio(F.sum("scores"), F.sum("n"), scales=(0, 0))
                 .alias("avg_review_score_repeat_customers"))
            .orderBy("customer_state"))


# R33
def state_loyalty_review_summary(loyalty: DataFrame, repeat_scores: DataFrame) -> DataFrame:
    return (loyalty.join(repeat_scores, "customer_state", "left")
            .select("customer_state", "total_customers", "repeat_customers",
                    "loyalty_percent", "avg_review_score_repeat_customers")
            .orderBy(F.desc("loyalty_percent"), "customer_state"))


# R34 -- item rows (not distinct products) of persons with exactly one order.
# One aggregate per person over their order rows (items counted per order
# first) tells both; persons whose only order has no items vanish, as with the
# reference's inner join, and a NULL person is never IN the one-time persons.
def one_time_customer_product_distribution(customers: DataFrame, orders: DataFrame,
                                           items: DataFrame) -> DataFrame:
    per_person = (order_persons(orders, customers)
                  .where(F.col("customer_unique_id").isNotNull())
                  .join(items_per_order(items).select("order_id", "item_rows"), "order_id", "left")
                  .groupBy("customer_unique_id")
                  .agg(more_than_one("order_id").alias("repeat"),
                       F.sum("item_rows").alias("products_in_order"))
                  .where(~F.col("repeat") & F.col("products_in_order").isNotNull()))
    return (per_person.groupBy(big("products_in_order").alias("products_in_order"))
            .agg(big(F.count(F.lit(1))).alias("customer_count"))
            .orderBy("products_in_order"))
