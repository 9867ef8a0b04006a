"""Pieces shared by several report chapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import big

# ---------------------------------------------------------------------------
# Order statuses the reports count as revenue, and the literal
# the data uses for a cancelled order.
# ---------------------------------------------------------------------------
FULFILLED: Sequence[str] = ("delivered", "shipped")
CANCELED = "canceled"
DELIVERED = "delivered"


def is_fulfilled(statuses: Sequence[str] = FULFILLED, col: str = "order_status") -> Column:
    """Status filter; Catalyst pushes it into the Parquet scan as ``In``."""
    return F.col(col).isin(*statuses)


def fulfilled_payments(payments: DataFrame, orders: DataFrame, statuses: Sequence[str],
                       *order_cols: str) -> DataFrame:
    """Payment lines of fulfilled orders."""
    return payments.join(orders.where(is_fulfilled(statuses)).select("order_id", *order_cols),
                         "order_id")


def order_persons(orders: DataFrame, customers: DataFrame, *customer_cols: str) -> DataFrame:
    """order_id, customer_unique_id (+ ``customer_cols``): every order row
    joined to the person behind it."""
    return (orders.select("order_id", "customer_id")
            .join(customers.select("customer_id", "customer_unique_id", *customer_cols),
                  "customer_id")
            .select("order_id", "customer_unique_id", *customer_cols))


def more_than_one(key: str) -> Column:
    """Aggregate: is there more than one distinct non-NULL ``key``? Unlike a
    distinct count it is a plain partial aggregate, so a person with a huge
    share of the orders is combined before the shuffle."""
    return F.coalesce(F.min(key) != F.max(key), F.lit(False))


def person_order_counts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """customer_unique_id -> total_orders (distinct orders over all checkouts).

    Exact COUNT(DISTINCT): Spark first de-duplicates on (person, order_id),
    which spreads even a person with a huge share of the orders over all
    shuffle partitions, then counts with a map-side partial aggregate.
    """
    return (order_persons(orders, customers)
            .groupBy("customer_unique_id")
            .agg(big(F.countDistinct("order_id")).alias("total_orders")))


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """order_id -> review_rows, score_sum, scored (reviews with a score)."""
    return (reviews.groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("review_rows"), F.sum("review_score").alias("score_sum"),
                 F.count("review_score").alias("scored")))


# One task of a join on an order's key holds its rows in several sorts and hash tables at once, some
# 450 bytes a row in all: with a share of 4 MB of a column store (0.7 million rows) about 300 MB.
SHARE_BYTES = 4 << 20
MOST_SHARES = 10_000  # beyond that the session's own, larger count of partitions is the one to raise


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` ahead of a join on it, so that a task's part stays the same
    size however many rows there are: adaptive execution merges partitions up to its advisory
    size of *compressed* shuffle data, and a fixed partition count grows with the input. The count is Spark's
    estimate of the rows' size over SHARE_BYTES, at least the session's. Rows are left
    as they are if they are few, stored by ``key`` (buckets) or of unknown size."""
    spark, planned = rows.sparkSession, rows._jdf.queryExecution()
    size = int(str(planned.optimizedPlan().stats().sizeInBytes()))
    shares = -(-size // SHARE_BYTES)
    if shares <= spark.sparkContext.defaultParallelism or size >= 1 << 60:
        return rows
    if planned.sparkPlan().outputPartitioning().toString().startswith(f"hashpartitioning({key}#"):
        return rows
    return rows.repartition(max(min(shares, MOST_SHARES), int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def without_match(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``left`` rows whose ``key`` is not in ``keys``: an anti join of two plain shuffles, which
    adaptive execution splits where one value holds a large part of ``left`` (an aggregate or
    distinct on the key's side would forbid that). Rows without a key never match; they go
    around the join, where they would all meet in one task."""
    keyed = left.where(F.col(key).isNotNull()).join(keys.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return keyed.select(*left.columns).unionByName(left.where(F.col(key).isNull()))


def category_of(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id -> product_category_name, english name (LEFT: untranslated kept as NULL)."""
    return (products.select("product_id", "product_category_name")
            .join(translation.select("product_category_name", "product_category_name_english"),
                  "product_category_name", "left"))


def items_per(items: DataFrame, key: str) -> DataFrame:
    """Item aggregates per ``key`` (order or product): item_rows, price_sum /
    price_n, freight_sum / freight_n, freight_max.

    Items are combined before they are joined: an order or a product has several
    items, so the shuffle carries fewer rows than there are items. SUM,
    COUNT and MAX compose, so summing these values over the join rows gives
    exactly the item-level result, duplicates in the joined table included.
    Unused columns are pruned from the aggregate by Catalyst.
    """
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_n"),
        F.max("freight_value").alias("freight_max"))


def items_per_order(items: DataFrame) -> DataFrame:
    return items_per(items, "order_id")
