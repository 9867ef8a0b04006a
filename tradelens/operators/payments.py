"""Chapter 2, payments.

Shares of a total: the groups are aggregated first (map-side partial
aggregation, one shuffle of a few rows per partition) and the total is the
sum over all groups, taken with an un-partitioned window over the aggregated
rows. Those rows are bounded by the number of payment types / instalment
counts, never by the number of payments, so the single window partition is
tiny, and the input is scanned once instead of once more for a scalar total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import big, mean_of, percent, round_half_up
from tradelens.operators.common import FULFILLED, fulfilled_payments

# ---------------------------------------------------------------------------
# Instalment counts above this are "high".
# ---------------------------------------------------------------------------
HIGH_INSTALLMENTS = 6



def _all_rows() -> Window:
    return Window.partitionBy()


# R09
def payment_type_distribution(payments: DataFrame, orders: DataFrame,
                              statuses=FULFILLED) -> DataFrame:
    g = (fulfilled_payments(payments, orders, statuses)
         .groupBy("payment_type")
         .agg(F.count(F.lit(1)).alias("n"), F.count("payment_value").alias("nv"),
              F.sum("payment_value").alias("s")))
    return (g.select(
        "payment_type",
        big("n").alias("num_transactions"),
        round_half_up(F.col("s"), 2).alias("total_revenue"),
        mean_of(F.col("s"), F.col("nv"), scale=2).alias("avg_payment_value"),
        percent(F.col("n"), F.sum("n").over(_all_rows()), scales=(0, 0))
        .alias("percentage_of_transactions"),
    ).orderBy(F.desc("total_revenue"), "payment_type"))


# R10
def installment_distribution(payments: DataFrame, orders: DataFrame,
                             statuses=FULFILLED) -> DataFrame:
    g = (fulfilled_payments(payments, orders, statuses)
         .groupBy("payment_installments").agg(F.count(F.lit(1)).alias("n")))
    return (g.select(
        "payment_installments",
        big("n").alias("count"),
        percent(F.col("n"), F.sum("n").over(_all_rows()), scales=(0, 0)).alias("percentage"),
    ).orderBy("payment_installments"))


# R11 -- instalments strictly above the threshold; the denominator is ALL
# fulfilled revenue, so every instalment group is aggregated and the high ones
# are selected after the window total.
def high_installment_revenue_share(payments: DataFrame, orders: DataFrame,
                                   threshold: int = HIGH_INSTALLMENTS,
                                   statuses=FULFILLED) -> DataFrame:
    g = (fulfilled_payments(payments, orders, statuses)
         .groupBy("payment_installments")
         .agg(F.count(F.lit(1)).alias("n"), F.count("payment_value").alias("nv"),
              F.sum("payment_value").alias("s")))
    return (g.select(
        "payment_installments",
        big("n").alias("count"),
        mean_of(F.col("s"), F.col("nv"), scale=2).alias("avg_value"),
        round_half_up(F.col("s"), 2).alias("total_value"),
        percent(F.col("s"), F.sum("s").over(_all_rows()), scales=(2, 2))
        .alias("percentage_of_total_revenue"),
    ).where(F.col("payment_installments") > threshold)
        .orderBy(F.desc("count"), "payment_installments"))


# R12 -- every order status (no filter).
def state_payment_behavior(payments: DataFrame, orders: DataFrame,
                           customers: DataFrame) -> DataFrame:
    return (payments.select("order_id", "payment_type", "payment_installments")
            .join(orders.select("order_id", "customer_id"), "order_id")
            .join(customers.select("customer_id", "customer_state"), "customer_id")
            .groupBy("customer_state", "payment_type")
            .agg(big(F.count(F.lit(1))).alias("total_transactions"),
                 mean_of(F.sum("payment_installments"), F.count("payment_installments"), scale=0)
                 .alias("avg_installments"))
            .orderBy(F.desc("total_transactions"), "customer_state", "payment_type"))
