"""Totals beside their groups from one pass (P44, P46, P47), and exact distinct
counts that roll up (P36, P37).

What rolls up is kept in a state per finest group and merged upwards; the joins below are read
once for all levels. ``level`` tells a total from a group whose name is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.functions.bands import DELIVERY_BANDS, DELIVERY_OTHERWISE, band
from tradelens.functions.numeric import big, percent, round_half_up, rounded_ratio, safe_ratio
from tradelens.operators.common import FULFILLED
from tradelens.operators.freight import RATIO_AVG_DIGITS, delivery_days, freight_ratio_rows, has_delivery_times
from tradelens.operators.sales import paid_by_place

PLACE = ["customer_state", "customer_city"]


def _at_level(names: dict[int, str]) -> Column:
    """Name of a grouping set by its grouping id."""
    out = F.lit(None).cast("string")
    for gid, name in names.items():
        out = F.when(F.col("gid") == gid, name).otherwise(out)
    return out.alias("level")


_PLACES = {0: "city", 1: "state", 3: "all"}


# ---- R05, R06 and the total revenue ----------------------------------------


def revenue_states(orders: DataFrame, payments: DataFrame, customers: DataFrame, statuses=FULFILLED) -> DataFrame:
    """customer_state, customer_city -> value, city_orders, state_orders, all_orders. Every order
    is marked once per city, once per state and once in all (its rows lie together after the join on
    order_id, so marking shuffles nothing): distinct counts of orders become sums that merge."""
    rows = paid_by_place(orders, payments, customers, statuses, *PLACE)
    first_in = lambda *keys: F.row_number().over(Window.partitionBy("order_id", *keys).orderBy(*PLACE)) == 1
    return (rows.select(*PLACE, "value", first_in("customer_state").alias("in_state"), first_in().alias("in_all"))
            .groupBy(*PLACE)
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("city_orders"),
                 F.count_if("in_state").alias("state_orders"), F.count_if("in_all").alias("all_orders")))


def revenue_levels(states: DataFrame) -> DataFrame:
    """R05 (level city), R06 (state) and the whole (all) from R05's states."""
    n = (F.when(F.col("gid") == 0, F.col("city_orders")).when(F.col("gid") == 1, F.col("state_orders"))
         .otherwise(F.col("all_orders")))
    sets = [[F.col(c) for c in PLACE], [F.col(PLACE[0])], []]
    merged = states.groupingSets(sets, *PLACE).agg(
        F.grouping_id().alias("gid"),
        *[F.sum(c).alias(c) for c in ("value", "city_orders", "state_orders", "all_orders")])
    return merged.where("value is not null or city_orders > 0").select(
        _at_level(_PLACES), *PLACE, round_half_up(F.col("value"), 2).alias("total_revenue"),
        big(n).alias("total_orders"), rounded_ratio(F.col("value"), n, scales=(2, 0)).alias("avg_order_value"))


# ---- R17 and R18 ------------------------------------------------------------


def freight_ratio_levels(items: DataFrame, orders: DataFrame, customers: DataFrame, statuses=FULFILLED) -> DataFrame:
    """R17 (level city) and R18 (state) from one pass over the orders."""
    ratio = safe_ratio(F.col("freight").cast("double"), F.col("value").cast("double"))
    states = (freight_ratio_rows(PLACE, items, orders, customers, statuses).groupBy(*PLACE)
              .agg(F.count("order_id").alias("orders"), F.sum(ratio).alias("ratios"), F.count(ratio).alias("ratio_n"),
                   F.sum("freight").alias("freight"), F.count("freight").alias("freight_n"),
                   F.sum("value").alias("value"), F.count("value").alias("value_n")))
    total = lambda c: F.sum(c)
    return (states.groupingSets([[F.col(c) for c in PLACE], [F.col(PLACE[0])]], *PLACE)
            .agg(F.grouping_id().alias("gid"), big(total("orders")).alias("total_orders"),
                 round_half_up(safe_ratio(total("ratios"), total("ratio_n")), RATIO_AVG_DIGITS).alias("avg_freight_ratio"),
                 safe_ratio(total("freight"), total("freight_n")).alias("avg_freight"),
                 safe_ratio(total("value"), total("value_n")).alias("avg_order_value"))
            .select(_at_level(_PLACES), *PLACE, "total_orders", "avg_freight_ratio", "avg_freight", "avg_order_value"))


# ---- R20 and R21 ------------------------------------------------------------


def delivery_band_levels(orders: DataFrame, customers: DataFrame, bands=DELIVERY_BANDS,
                         otherwise: str = DELIVERY_OTHERWISE) -> DataFrame:
    """R20 (level all) and R21 (state) from one pass: an order counts once in all, whether it has a customer row or
    not, and once for each of its customer's rows in their states."""
    whose = customers.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.collect_list(F.struct(F.lit("state").alias("level"), F.col("customer_state"))).alias("places"))
    own = F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("customer_state"))
    counts = (orders.where(has_delivery_times()).select("customer_id", band(delivery_days(), bands, otherwise).alias("delivery_band"))
              .join(whose, "customer_id", "left")
              .select("delivery_band", F.explode(F.concat(F.array(own), F.coalesce("places", F.array().cast("array<struct<level:string,customer_state:string>>")))).alias("p"))
              .groupBy("p.level", "p.customer_state", "delivery_band").agg(big(F.count(F.lit(1))).alias("orders_in_band")))
    whole = F.sum("orders_in_band").over(Window.partitionBy("level", "customer_state"))  # a row per band
    return counts.select("level", "customer_state", "delivery_band", "orders_in_band",
                         percent(F.col("orders_in_band"), whole, scales=(0, 0)).alias("percent_of_level"))


# ---- distinct counts that merge ----------------------------------------------


def distinct_states(rows: DataFrame, groups: list[str], key: str) -> DataFrame:
    """The distinct values of ``key`` per group, in a form that merges exactly.

    Integer keys become bitmaps, one of 4 KB for each range of 32,768 values that the group touches: right for keys that are
    numbered through (a group with millions of members needs a few bits for each), wasteful for
    hash-like ones. Other keys are kept as one row each."""
    known = rows.where(F.col(key).isNotNull())
    if isinstance(rows.schema[key].dataType, T.IntegralType):
        value = F.col(key).cast("long")
        return (known.groupBy(*groups, F.bitmap_bucket_number(value).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")))
    return known.select(*groups, F.col(key).alias("member")).distinct()


def merged_states(states: DataFrame, groups: list[str]) -> DataFrame:
    """States of coarser groups (columns of the states, or made from them)."""
    if "bits" in states.columns:
        return states.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return states.select(*groups, "member").distinct()


def counted_states(states: DataFrame, groups: list[str], name: str) -> DataFrame:
    n = F.sum(F.bitmap_count("bits")) if "bits" in states.columns else F.count("member")
    return states.groupBy(*groups).agg(big(n).alias(name))


def buyers_by_period(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct persons per month, year and in all: level, year, month, buyers. Years and the whole are
    merged from the months' states, not counted again."""
    rows = (orders.select("customer_id", F.year("purchase_time").alias("year"), F.month("purchase_time").alias("month"))
            .join(customers.select("customer_id", "customer_unique_id"), "customer_id"))
    months = distinct_states(rows, ["year", "month"], "customer_unique_id")
    years = merged_states(months, ["year"])
    whole = merged_states(years.withColumn("all", F.lit(0)), ["all"])
    parts = [counted_states(months, ["year", "month"], "buyers").withColumn("level", F.lit("month")),
             counted_states(years, ["year"], "buyers").withColumn("level", F.lit("year")),
             counted_states(whole, ["all"], "buyers").withColumn("level", F.lit("all")).drop("all")]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("level", big("year").alias("year"), big("month").alias("month"), "buyers")
