"""Chapter 3, freight and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.bands import (
    DELIVERY_BANDS,
    DELIVERY_OTHERWISE,
    FREIGHT_BANDS,
    FREIGHT_OTHERWISE,
    SHIPPING_BANDS,
    SHIPPING_OTHERWISE,
    band,
    band_order,
)
from tradelens.functions.numeric import (
    big,
    percent,
    round_half_up,
    rounded_ratio,
    safe_ratio,
)
from tradelens.operators.common import DELIVERED, FULFILLED, is_fulfilled, items_per_order

# ---------------------------------------------------------------------------
# Divisor of the volumetric ("dimensional") weight, cm^3 per kg.
# ---------------------------------------------------------------------------
DIM_WEIGHT_DIVISOR = 6000
# Digits kept for averages of per-order DOUBLE ratios: their floating sum
# depends on the order rows arrive in, so the last bits are not reproducible.
RATIO_AVG_DIGITS = 8


def delivery_days() -> Column:
    """DATEDIFF(delivered, purchased): whole calendar days, time of day ignored."""
    return F.datediff(F.col("delivered_time"), F.col("purchase_time"))


def has_delivery_times() -> Column:
    return F.col("delivered_time").isNotNull() & F.col("purchase_time").isNotNull()


def _weights() -> list[Column]:
    dims = (F.col("product_length_cm") * F.col("product_height_cm")
            * F.col("product_width_cm"))
    # Summed before the division: exact for integral dimensions, and
    # independent of the order in which rows are added.
    return [
        F.sum("product_weight_g").alias("total_actual_weight_g"),
        (F.sum(dims) / DIM_WEIGHT_DIVISOR).alias("total_dim_weight_kg"),
    ]


_PRODUCT_WEIGHT_COLS = ["product_id", "product_weight_g", "product_length_cm",
                        "product_height_cm", "product_width_cm"]


# R14
def order_weight_summary(items: DataFrame, products: DataFrame) -> DataFrame:
    """Inner join: orders whose items all lack product metadata are absent."""
    return (items.select("order_id", "product_id")
            .join(products.select(*_PRODUCT_WEIGHT_COLS), "product_id")
            .groupBy("order_id").agg(*_weights()))


# R13 (+ A27) -- MAX(freight) per order widened with R14's weights.
def order_freight_total(items: DataFrame, products: DataFrame) -> DataFrame:
    """One aggregate instead of aggregate + aggregate + left join: over items
    LEFT JOIN products, the weight sums only see matched items and are NULL
    when none matched -- exactly what the left join to R14 yields -- while
    MAX(freight) still sees every item of the order."""
    return (items.select("order_id", "product_id", "freight_value")
            .join(products.select(*_PRODUCT_WEIGHT_COLS), "product_id", "left")
            .groupBy("order_id")
            .agg(F.max("freight_value").cast("double").alias("freight_value"), *_weights()))


def _orders_with_state(orders: DataFrame, customers: DataFrame, order_filter: Column | None,
                       cols: list[str]) -> DataFrame:
    o = orders if order_filter is None else orders.where(order_filter)
    return (o.select("order_id", "customer_id", *cols)
            .join(customers.select("customer_id", "customer_state"), "customer_id"))


# R15
def state_freight_bucket_summary(items: DataFrame, orders: DataFrame, customers: DataFrame,
                                 bands=FREIGHT_BANDS, otherwise: str = FREIGHT_OTHERWISE,
                                 statuses=FULFILLED) -> DataFrame:
    # The last join is on order_id, so the (order_id, state) aggregate reuses
    # that hash partitioning without another shuffle.
    per_order = (_orders_with_state(orders, customers, is_fulfilled(statuses), [])
                 .join(items_per_order(items).select("order_id", "freight_sum"), "order_id")
                 .groupBy("order_id", "customer_state")
                 .agg(F.sum("freight_sum").alias("total_freight")))
    return (per_order
            .groupBy("customer_state",
                     band(F.col("total_freight"), bands, otherwise).alias("freight_bucket"))
            .agg(big(F.count(F.lit(1))).alias("order_count"))
            .orderBy("customer_state", "freight_bucket"))


def _value_vs_freight(items: DataFrame, orders: DataFrame, statuses) -> DataFrame:
    # Per-order item aggregate first; the group-by after the join re-applies
    # the reference's join-then-aggregate (a no-op for unique order ids).
    return (items_per_order(items).select("order_id", "price_sum", "freight_max")
            .join(orders.where(is_fulfilled(statuses)).select("order_id"), "order_id")
            .groupBy("order_id")
            .agg(F.sum("price_sum").alias("value"), F.max("freight_max").alias("freight")))


# R16
def order_value_vs_freight(items: DataFrame, orders: DataFrame,
                           statuses=FULFILLED) -> DataFrame:
    return _value_vs_freight(items, orders, statuses).select(
        "order_id",
        F.col("value").cast("double").alias("total_order_value"),
        F.col("freight").cast("double").alias("freight_value"),
        rounded_ratio(F.col("freight"), F.col("value"), 4, scales=(2, 2)).alias("freight_ratio"),
    )


def freight_ratio_rows(keys: list[str], items: DataFrame, orders: DataFrame,
                       customers: DataFrame, statuses) -> DataFrame:
    """R16's values with their place (order_id, value, freight, ``keys``), in one pass over the orders: where the
    reference joins R16 to the orders again for the customer, the aggregate per order
    carries the customers of its rows (one, unless an order id is repeated)."""
    paid = is_fulfilled(statuses)
    per_order = (items_per_order(items).select("order_id", "price_sum", "freight_max")
                 .join(orders.select("order_id", "customer_id", "order_status"), "order_id")
                 .groupBy("order_id")
                 .agg(F.sum(F.when(paid, F.col("price_sum"))).alias("value"),
                      F.max(F.when(paid, F.col("freight_max"))).alias("freight"),
                      F.count_if(paid).alias("n"), F.collect_list("customer_id").alias("ids"))
                 .where(F.col("n") > 0))
    return (per_order.select("order_id", "value", "freight", F.explode("ids").alias("customer_id"))
            .join(customers.select("customer_id", *keys), "customer_id"))


def _freight_ratio_by(keys: list[str], items: DataFrame, orders: DataFrame,
                      customers: DataFrame, statuses) -> DataFrame:
    rows = freight_ratio_rows(keys, items, orders, customers, statuses)
    ratio = safe_ratio(F.col("freight").cast("double"), F.col("value").cast("double"))
    return (rows.groupBy(*keys)
            .agg(big(F.count("order_id")).alias("total_orders"),
                 round_half_up(F.avg(ratio), RATIO_AVG_DIGITS).alias("avg_freight_ratio"),
                 safe_ratio(F.sum("freight"), F.count("freight")).alias("avg_freight"),
                 safe_ratio(F.sum("value"), F.count("value")).alias("avg_order_value"))
            .orderBy(F.desc_nulls_last("avg_freight_ratio"), *keys))


# R17 -- averages of the unrounded per-order ratio.
def freight_ratio_by_region(items: DataFrame, orders: DataFrame, customers: DataFrame,
                            statuses=FULFILLED) -> DataFrame:
    return _freight_ratio_by(["customer_state", "customer_city"], items, orders, customers, statuses)


# R18
def freight_ratio_by_state(items: DataFrame, orders: DataFrame, customers: DataFrame,
                           statuses=FULFILLED) -> DataFrame:
    return _freight_ratio_by(["customer_state"], items, orders, customers, statuses)


# R19 -- item grain: an order's delivery days are added once per item.
def freight_by_state(items: DataFrame, orders: DataFrame, customers: DataFrame,
                     status: str = DELIVERED) -> DataFrame:
    cond = ((F.col("order_status") == status) & has_delivery_times() & (delivery_days() > 0))
    rows = (_orders_with_state(orders, customers, cond, ["purchase_time", "delivered_time"])
            .join(items_per_order(items).select("order_id", "item_rows", "freight_sum"),
                  "order_id")
            .withColumn("days", delivery_days()))
    # Item grain from per-order aggregates: each item adds the order's days.
    freight = F.sum("freight_sum")
    days = F.sum(F.col("item_rows") * F.col("days"))
    n = F.countDistinct("order_id")
    return (rows.groupBy("customer_state")
            .agg(round_half_up(freight, 2).alias("total_freight"),
                 big(days).alias("total_delivery_days"),
                 big(n).alias("total_orders"),
                 rounded_ratio(freight, days, scales=(2, 0)).alias("avg_freight_per_day"),
                 rounded_ratio(freight, n, scales=(2, 0)).alias("avg_freight_per_order"),
                 rounded_ratio(days, n, scales=(0, 0)).alias("avg_delivery_days"))
            .orderBy(F.desc_nulls_last("avg_freight_per_day"), "customer_state"))


# R20 -- every status; a negative day count lands in the ELSE band.
def delivery_time_distribution(orders: DataFrame, bands=DELIVERY_BANDS,
                               otherwise: str = DELIVERY_OTHERWISE) -> DataFrame:
    counts = (orders.where(has_delivery_times())
              .groupBy(band(delivery_days(), bands, otherwise).alias("delivery_band"))
              .agg(big(F.count(F.lit(1))).alias("orders_in_band")))
    return (counts.select("delivery_band", "orders_in_band",
                          percent(F.col("orders_in_band"),
                                  F.sum("orders_in_band").over(Window.partitionBy()),
                                  scales=(0, 0))
                          .alias("percent_of_total"))
            .orderBy(band_order(F.col("delivery_band"), bands)))


# R21
def delivery_band_by_state(orders: DataFrame, customers: DataFrame, bands=DELIVERY_BANDS,
                           otherwise: str = DELIVERY_OTHERWISE) -> DataFrame:
    counts = (_orders_with_state(orders, customers, has_delivery_times(),
                                 ["purchase_time", "delivered_time"])
              .groupBy("customer_state",
                       band(delivery_days(), bands, otherwise).alias("delivery_band"))
              .agg(big(F.count(F.lit(1))).alias("orders_in_band")))
    state_total = F.sum("orders_in_band").over(Window.partitionBy("customer_state"))
    return (counts.select("customer_state", "delivery_band", "orders_in_band",
                          percent(F.col("orders_in_band"), state_total, scales=(0, 0))
                          .alias("percent_within_state"))
            .orderBy("customer_state", band_order(F.col("delivery_band"), bands)))


# R22
def approval_to_shipping_bands(orders: DataFrame, bands=SHIPPING_BANDS,
                               otherwise: str = SHIPPING_OTHERWISE,
                               statuses=FULFILLED) -> DataFrame:
    days = F.datediff(F.col("order_delivered_carrier_date"), F.col("order_approved_at"))
    counts = (orders.where(is_fulfilled(statuses)
                           & F.col("order_approved_at").isNotNull()
                           & F.col("order_delivered_carrier_date").isNotNull())
              .groupBy(band(days, bands, otherwise).alias("approval_to_shipping_band"))
              .agg(big(F.count(F.lit(1))).alias("order_count")))
    return (counts.select("approval_to_shipping_band", "order_count",
                          percent(F.col("order_count"),
                                  F.sum("order_count").over(Window.partitionBy()),
                                  scales=(0, 0))
                          .alias("percentage_of_orders"))
            .orderBy(F.desc("order_count"), "approval_to_shipping_band"))
