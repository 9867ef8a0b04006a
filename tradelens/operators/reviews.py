"""Chapter 4, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import big, rounded_ratio
from tradelens.operators.common import category_of, reviews_per_order
from tradelens.operators.freight import delivery_days, has_delivery_times


def _scored(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("review_score").isNotNull()).select("order_id", "review_score")


def _avg_score(name: str = "avg_review_score"):
    return rounded_ratio(F.sum("review_score"), F.count("review_score"), scales=(0, 0)).alias(name)


# R23 -- review x item grain; untranslated categories form one NULL group.
# Reviews are combined per order and joined to the orders before the items come
# in (their one shuffle); then everything is combined per product.
def category_review_summary(reviews: DataFrame, orders: DataFrame, items: DataFrame,
                            products: DataFrame, translation: DataFrame) -> DataFrame:
    reviewed = (reviews_per_order(_scored(reviews))
                .join(orders.select("order_id"), "order_id"))
    per_product = (items.select("order_id", "product_id").join(reviewed, "order_id")
                   .groupBy("product_id")
                   .agg(F.sum("review_rows").alias("pairs"), F.sum("score_sum").alias("scores")))
    return (per_product.join(category_of(products, translation), "product_id")
            .groupBy(F.col("product_category_name_english").alias("category_name"))
            .agg(rounded_ratio(F.sum("scores"), F.sum("pairs"), scales=(0, 0)).alias("avg_review_score"),
                 big(F.sum("pairs")).alias("review_count"))
            .orderBy(F.desc_nulls_last("avg_review_score"), "category_name"))


# R24 -- title + ' ' + message (NULL as ''); kept when either is non-blank.
# TRIM removes spaces only, as in the reference; the score may be NULL.
def review_text_by_score(reviews: DataFrame) -> DataFrame:
    title, message = F.col("review_comment_title"), F.col("review_comment_message")
    keep = (F.coalesce(F.trim(message) != "", F.lit(False))
            | F.coalesce(F.trim(title) != "", F.lit(False)))
    return reviews.where(keep).select(
        "review_score",
        F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
        .alias("full_review_text"),
    )


# R25
def delivery_time_vs_review_score(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    rows = (_scored(reviews)
            .join(orders.where(has_delivery_times())
                  .select("order_id", "purchase_time", "delivered_time"), "order_id")
            .withColumn("days", delivery_days()))
    return (rows.groupBy("review_score")
            .agg(rounded_ratio(F.sum("days"), F.count("days"), scales=(0, 0)).alias("avg_delivery_days"),
                 big(F.count(F.lit(1))).alias("review_count"))
            .orderBy("review_score"))


# R26
def state_review_summary(reviews: DataFrame, orders: DataFrame,
                         customers: DataFrame) -> DataFrame:
    rows = (_scored(reviews)
            .join(orders.select("order_id", "customer_id"), "order_id")
            .join(customers.select("customer_id", "customer_state"), "customer_id"))
    return (rows.groupBy("customer_state")
            .agg(_avg_score(), big(F.count(F.lit(1))).alias("review_count"))
            .orderBy("avg_review_score", "customer_state"))
