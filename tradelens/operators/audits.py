"""Data-quality and exploration operators.

Every "LEFT JOIN ... WHERE right.key IS NULL" probe of the reference is written
as a ``left_anti`` join and every ``IN (subquery)`` / ``EXISTS`` as a
``left_semi`` join: Spark then plans an anti/semi hash or sort-merge join that
never materialises the matched pairs. The probed side is reduced to its
distinct keys first (:func:`keys_of`): the de-duplication is partial
(map-side), and its output is already partitioned by the key, so a
sort-merge semi/anti join on it needs no further shuffle of that side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.bands import (
    LATE_AFTER_DAYS,
    LATE_DELIVERY_BANDS,
    LATE_DELIVERY_OTHERWISE,
    band,
    band_order,
)
from tradelens.functions.numeric import big, mean_of, percent, round_half_up, year_month
from tradelens.operators.common import (
    FULFILLED,
    dealt_by,
    fulfilled_payments,
    is_fulfilled,
    more_than_one,
    without_match,
)
from tradelens.operators.freight import delivery_days, has_delivery_times
from tradelens.operators.payments import HIGH_INSTALLMENTS
from tradelens.sources.versioned import VersionedTable


# ---------------------------------------------------------------------------
# Sizes of the repeated-person sample and of a preview.
# ---------------------------------------------------------------------------
PERSON_SAMPLE = 10
PREVIEW_ROWS = 10


def keys_of(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL values of ``key`` (a NULL key never matches anyway)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


# A01
def time_range(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.max("purchase_time").alias("Last_purchase"),
        F.min("purchase_time").alias("first_purchase"),
    )


# A02
def row_counts(tables: dict[str, DataFrame], key_columns: dict[str, str] | None = None) -> DataFrame:
    """One row per table: COUNT(key) when a key column is named, else COUNT(*)."""
    key_columns = key_columns or {}
    parts = []
    for name, df in tables.items():
        key = key_columns.get(name)
        n = F.count(key) if key else F.count(F.lit(1))
        parts.append(df.agg(F.lit(name).alias("table_name"), big(n).alias("row_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# A03
def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return (df.groupBy(key).agg(big(F.count(F.lit(1))).alias("count"))
            .where(F.col("count") > 1))


# A04
def order_payment_detail(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return orders.join(payments, "order_id").select(
        "order_id", "customer_id", "purchase_time", "payment_type",
        F.col("payment_value").cast("double").alias("payment_value"),
    )


# A05
def payments_without_orders(payments: DataFrame, orders: DataFrame) -> DataFrame:
    return without_match(payments.select("order_id"), orders, "order_id")


# A06
def orders_without_payments_count(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return (orders.join(keys_of(payments, "order_id"), "order_id", "left_anti")
            .agg(big(F.count(F.lit(1))).alias("orders_without_payments")))


# A07
def orders_without_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return (orders.join(keys_of(payments, "order_id"), "order_id", "left_anti")
            .select("order_id", "purchase_time"))


# A08 -- the DELETE ... WHERE NOT EXISTS clean-up, as the kept rows.
def keep_paid_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return orders.join(keys_of(payments, "order_id"), "order_id", "left_semi")


# A09
def order_status_histogram(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("order_status")
            .agg(big(F.count(F.lit(1))).alias("total_orders"))
            .orderBy(F.desc("total_orders"), "order_status"))


# A10
def total_revenue(orders: DataFrame, payments: DataFrame, statuses=FULFILLED) -> DataFrame:
    return fulfilled_payments(payments, orders, statuses, "purchase_time").agg(
        round_half_up(F.sum("payment_value"), 2).alias("total_revenue"))


# A11
def revenue_by_year(orders: DataFrame, payments: DataFrame, statuses=FULFILLED) -> DataFrame:
    return (fulfilled_payments(payments, orders, statuses, "purchase_time")
            .groupBy(big(F.year("purchase_time")).alias("year"))
            .agg(round_half_up(F.sum("payment_value"), 2).alias("revenue"))
            .orderBy("year"))


# A12
def revenue_by_month(orders: DataFrame, payments: DataFrame, statuses=FULFILLED) -> DataFrame:
    return (fulfilled_payments(payments, orders, statuses, "purchase_time")
            .groupBy(year_month("purchase_time").alias("month"))
            .agg(round_half_up(F.sum("payment_value"), 2).alias("total_revenue"))
            .orderBy("month"))


# A13 -- the extra status condition in the reference's ON clause cannot change
# the count (the probe tests the item side), so it is left out.
def sellers_with_no_sales(sellers: DataFrame, items: DataFrame) -> DataFrame:
    return (sellers.join(keys_of(items, "seller_id"), "seller_id", "left_anti")
            .agg(big(F.count(F.lit(1))).alias("sellers_with_no_sales")))


# A14
def sellers_with_only_unfulfilled_orders(sellers: DataFrame, items: DataFrame, orders: DataFrame,
                                         statuses=FULFILLED) -> DataFrame:
    return sellers_with_only_unfulfilled_orders_of(
        sellers, dealt_by(items.select("order_id", "seller_id"), "order_id").join(orders.select("order_id", "order_status"), "order_id"), statuses)


def sellers_with_only_unfulfilled_orders_of(sellers: DataFrame, sold: DataFrame, statuses=FULFILLED) -> DataFrame:
    # One row per seller before membership is tested (a repeated seller row
    # cannot turn a zero into a non-zero).
    per_seller = (sold.groupBy("seller_id")
                  .agg(F.count_if(is_fulfilled(statuses)).alias("fulfilled_rows")))
    return (per_seller.where(F.col("fulfilled_rows") == 0)
            .join(keys_of(sellers, "seller_id"), "seller_id", "left_semi")
            .agg(big(F.count(F.lit(1))).alias("sellers_with_only_unfulfilled_orders")))


# A15 -- raw payment lines, no order join (as in the reference).
def high_installment_profile(payments: DataFrame,
                             threshold: int = HIGH_INSTALLMENTS) -> DataFrame:
    return (payments.where(F.col("payment_installments") > threshold)
            .groupBy("payment_installments")
            .agg(big(F.count(F.lit(1))).alias("count"),
                 mean_of(F.sum("payment_value"), F.count("payment_value"), scale=2).alias("avg_value"))
            .orderBy(F.desc("count"), "payment_installments"))


# A16 -- SUM of freight per order (R13 keeps the MAX).
def order_freight_sum(items: DataFrame) -> DataFrame:
    return (items.groupBy("order_id")
            .agg(F.sum("freight_value").cast("double").alias("total_freight")))


# A17
def items_per_order_histogram(items: DataFrame) -> DataFrame:
    per_order = items.groupBy("order_id").agg(big(F.count(F.lit(1))).alias("item_count"))
    return (per_order.groupBy("item_count")
            .agg(big(F.count(F.lit(1))).alias("number_of_orders"))
            .orderBy("item_count"))


# A18 -- one scan per table, whatever the number of its keys.
def distinct_counts(items: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The five exact distinct counts of the reference, one row per metric."""
    specs = [("order_items", items, ["order_id"]), ("orders", orders, ["order_id", "customer_id"]),
             ("customers", customers, ["customer_id", "customer_unique_id"])]
    parts = []
    for table, df, keys in specs:
        counts = df.agg(*[big(F.countDistinct(k)).alias(k) for k in keys])
        metrics = F.array(*[F.struct(F.lit(f"{table}.{k}").alias("metric"), F.col(k).alias("distinct_count")) for k in keys])
        parts.append(counts.select(F.explode(metrics).alias("m")).select("m.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# A19
def orders_without_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    return (orders.join(keys_of(items, "order_id"), "order_id", "left_anti")
            .agg(big(F.count(F.lit(1))).alias("orders_without_items")))


# A20 -- a bestseller's items are split by adaptive execution.
def orders_with_unmatched_products(items: DataFrame, products: DataFrame) -> DataFrame:
    return (without_match(items.select("order_id", "product_id"), products, "product_id")
            .agg(big(F.countDistinct("order_id")).alias("unmatched_orders")))


# A21 -- one pass: band every delivered order (orders up to the threshold form
# their own group so the denominator is the sum over all groups), then drop
# that group. The window runs over at most five aggregated rows.
def late_delivery_bands(orders: DataFrame, after_days: int = LATE_AFTER_DAYS) -> DataFrame:
    days = delivery_days()
    banded = orders.where(has_delivery_times()).select(
        F.when(days > after_days, band(days, LATE_DELIVERY_BANDS, LATE_DELIVERY_OTHERWISE))
        .alias("delivery_band"))
    counts = banded.groupBy("delivery_band").agg(big(F.count(F.lit(1))).alias("orders_in_band"))
    total = F.sum("orders_in_band").over(Window.partitionBy())
    return (counts.select("delivery_band", "orders_in_band",
                          percent(F.col("orders_in_band"), total, scales=(0, 0)).alias("percent_of_total"))
            .where(F.col("delivery_band").isNotNull())
            .orderBy(band_order(F.col("delivery_band"), LATE_DELIVERY_BANDS)))


# A22
def orders_with_unknown_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return (keys_of(orders, "customer_id")
            .join(keys_of(customers, "customer_id"), "customer_id", "left_anti")
            .agg(big(F.count(F.lit(1))).alias("unknown_customer_ids")))


# A23 -- a sample by definition: the first k repeated persons in key order.
def repeated_person_sample(customers: DataFrame, k: int = PERSON_SAMPLE) -> DataFrame:
    return (customers.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).select("customer_unique_id")
            .orderBy("customer_unique_id").limit(k))


# A24
def orders_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return (orders.select("order_id", "customer_id")
            .join(customers.select("customer_id", "customer_state"), "customer_id")
            .groupBy("customer_state")
            .agg(big(F.countDistinct("order_id")).alias("total_orders"))
            .orderBy(F.desc("total_orders"), "customer_state"))


def top_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One-row DataFrame: the state with the most orders (ties by name)."""
    return orders_by_state(orders, customers).limit(1).select("customer_state")


# A25 -- persons with more than one order and at least one cancelled order,
# from one per-person aggregate (no semi join back to the order rows); a NULL
# person is not counted, as COUNT(DISTINCT) skips it.
def repeat_customers_with_cancellations(customers: DataFrame, orders: DataFrame,
                                        canceled: str = "canceled") -> DataFrame:
    per_person = (orders.select("order_id", "customer_id", "order_status")
                  .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
                  .groupBy("customer_unique_id")
                  .agg(more_than_one("order_id").alias("repeat"),
                       F.max((F.col("order_status") == canceled).cast("int")).alias("cancelled")))
    return (per_person.where(F.col("repeat") & (F.col("cancelled") == 1)
                             & F.col("customer_unique_id").isNotNull())
            .agg(big(F.count(F.lit(1))).alias("repeat_customers_with_cancellations")))


# A26 -- a preview by definition: the first k rows in key order.
def preview(df: DataFrame, key: str, k: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(key).limit(k)


# P07 -- the clean-up as a change of a stored table.
PURCHASE_MONTH = "date_format(purchase_time, 'yyyy-MM')"


def delete_unpaid_orders(table: VersionedTable, payments: DataFrame) -> DataFrame:
    """DELETE the orders without a payment from a stored orders table, partition by partition. One row per
    partition before: month, rows_before, rows_deleted, rewritten, and of what the table holds
    afterwards rows_kept, first_order, last_order (NULL where nothing is left)."""
    report = table.delete_unmatched(payments, "order_id")
    kept = table.read().groupBy(F.expr(PURCHASE_MONTH).alias("label")).agg(
        big(F.count(F.lit(1))).alias("rows_kept"), F.min("order_id").alias("first_order"), F.max("order_id").alias("last_order"))
    own = kept.select(F.col("label").alias("kept_label"), "rows_kept", "first_order", "last_order")
    return (report.join(own, F.col("label").eqNullSafe(F.col("kept_label")), "left")
            .select(F.col("label").alias("month"), "rows_before", "rows_deleted", "rewritten",
                    F.coalesce("rows_kept", F.lit(0)).cast("long").alias("rows_kept"), "first_order", "last_order"))
