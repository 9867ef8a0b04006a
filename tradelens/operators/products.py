"""Chapter 6, products and cancellations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import big, mean_of, percent
from tradelens.operators.common import CANCELED, FULFILLED, category_of, is_fulfilled, items_per
from tradelens.operators.heavy_hitters import top_k

_SUM_TYPE = "decimal(38,2)"


# R35 -- no status filter; ``k`` turns the ranking into a top-k report.
def most_sold_products(items: DataFrame, products: DataFrame, translation: DataFrame,
                       k: int | None = None) -> DataFrame:
    # Units are counted per product before the join (exact: each join row of
    # a product carries that product's count).
    out = (items_per(items, "product_id").select("product_id", "item_rows")
           .join(category_of(products, translation), "product_id")
           .groupBy("product_id", F.col("product_category_name_english").alias("category_name"))
           .agg(big(F.sum("item_rows")).alias("total_units_sold"))
           .orderBy(F.desc("total_units_sold"), "product_id", "category_name"))
    return out if k is None else out.limit(k)


def top_products(items: DataFrame, products: DataFrame, translation: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of R35 for very many products: only products that may be among them are
    counted one by one. Repeated product rows weigh as in R35's join."""
    english = F.col("product_category_name_english").alias("category_name")
    named = (category_of(products, translation).where(F.col("product_id").isNotNull())
             .groupBy("product_id", english).agg(F.count(F.lit(1)).alias("weight")))
    return (top_k(items.where(F.col("product_id").isNotNull()), "product_id", k, weights=named)
            .withColumnRenamed("n", "total_units_sold"))


def _single_items(items: DataFrame) -> DataFrame:
    """One aggregate per order finds the single-item orders *and* carries
    their item: in a group of exactly one row, any_value is that row. Items
    are read once, with a map-side partial aggregate, instead of an
    aggregate plus a semi join back to the items."""
    return (items.groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.any_value("product_id").alias("product_id"),
                 F.any_value("price").alias("price"),
                 F.any_value("freight_value").alias("freight_value"))
            .where(F.col("n") == 1).drop("n"))


# R36 -- detail rows of orders with exactly one item row, fulfilled.
def single_item_orders(items: DataFrame, orders: DataFrame, products: DataFrame,
                       translation: DataFrame, statuses=FULFILLED) -> DataFrame:
    return (_single_items(items)
            .join(orders.where(is_fulfilled(statuses)).select("order_id"), "order_id")
            .join(category_of(products, translation), "product_id")
            .select("order_id", "product_id", "product_category_name",
                    "product_category_name_english",
                    F.col("price").cast("double").alias("price"),
                    F.col("freight_value").cast("double").alias("freight_value")))


def _price_freight_aggs() -> list[Column]:
    price = F.col("price").cast(_SUM_TYPE)
    freight = F.col("freight_value").cast(_SUM_TYPE)
    return [mean_of(F.sum(price), F.count(price), scale=2).alias("avg_price"),
            mean_of(F.sum(freight), F.count(freight), scale=2).alias("avg_freight")]


# R37
def avg_price_freight_by_category(single_items: DataFrame) -> DataFrame:
    return (single_items
            .groupBy(F.col("product_category_name_english").alias("category_name"))
            .agg(*_price_freight_aggs())
            .orderBy(F.desc_nulls_last("avg_freight"), "category_name"))


# R38 -- ``state`` is a name, or a Column such as a scalar subquery
# (audits.top_state(...).scalar() picks the state with the most orders). Where the
# reference joins R36 to the orders again for the customer, the orders are
# combined per id once: the customers of its rows, and how many are fulfilled
# (one of each, unless an order id is repeated), which weights the item.
def avg_price_freight_by_category_in_state(items: DataFrame, orders: DataFrame, products: DataFrame,
                                           translation: DataFrame, customers: DataFrame,
                                           state: str | Column = "SP", statuses=FULFILLED) -> DataFrame:
    wanted = F.lit(state) if isinstance(state, str) else state
    per_order = (orders.groupBy("order_id")
                 .agg(F.count_if(is_fulfilled(statuses)).alias("weight"),
                      F.collect_list("customer_id").alias("ids"))
                 .where(F.col("weight") > 0))
    rows = (_single_items(items).join(per_order, "order_id")
            .select("product_id", "price", "freight_value", "weight", F.explode("ids").alias("customer_id"))
            .join(customers.select("customer_id", "customer_state"), "customer_id")
            .where(F.col("customer_state") == wanted)
            .join(category_of(products, translation), "product_id"))

    def mean(column: str) -> Column:
        return mean_of(F.sum(F.col(column) * F.col("weight")),
                       F.sum(F.when(F.col(column).isNotNull(), F.col("weight"))), scale=2)

    return (rows.groupBy(F.col("product_category_name_english").alias("category_name"))
            .agg(mean("price").alias("avg_price"), mean("freight_value").alias("avg_freight"))
            .orderBy(F.desc_nulls_last("avg_freight"), "category_name"))


# R39 -- COUNT(*) counts item rows of cancelled orders. The few cancelled orders
# meet the items first; what is left is combined per product.
def cancelled_orders_by_category(orders: DataFrame, items: DataFrame, products: DataFrame,
                                 translation: DataFrame, canceled: str = CANCELED) -> DataFrame:
    of_cancelled = (items.select("order_id", "product_id", "price", "freight_value")
                    .join(orders.where(F.col("order_status") == canceled).select("order_id"), "order_id"))
    return (items_per(of_cancelled, "product_id")
            .join(category_of(products, translation), "product_id")
            .groupBy(F.col("product_category_name_english").alias("category_name"))
            .agg(big(F.sum("item_rows")).alias("cancelled_order_count"),
                 mean_of(F.sum("price_sum"), F.sum("price_n"), scale=2).alias("avg_price"),
                 mean_of(F.sum("freight_sum"), F.sum("freight_n"), scale=2).alias("avg_freight"))
            .orderBy(F.desc("cancelled_order_count"), "category_name"))


# R40
def cancelled_orders_by_zip(orders: DataFrame, customers: DataFrame,
                            canceled: str = CANCELED) -> DataFrame:
    return (orders.where(F.col("order_status") == canceled).select("customer_id")
            .join(customers.select("customer_id", "customer_zip_code_prefix"), "customer_id")
            .groupBy("customer_zip_code_prefix")
            .agg(big(F.count(F.lit(1))).alias("cancelled_order_count"))
            .orderBy(F.desc("cancelled_order_count"), "customer_zip_code_prefix"))


# R41 -- the correlated per-state total of the reference as one conditional
# aggregate. The correlated form matches no row for a NULL state, so that
# group reports 0 orders and a NULL rate, as the subquery would.
def cancelled_orders_by_state(orders: DataFrame, customers: DataFrame,
                              canceled: str = CANCELED) -> DataFrame:
    g = (orders.select("customer_id", "order_status")
         .join(customers.select("customer_id", "customer_state"), "customer_id")
         .groupBy("customer_state")
         .agg(F.count_if(F.col("order_status") == canceled).alias("cancelled"),
              F.count(F.lit(1)).alias("all_orders"))
         .where(F.col("cancelled") > 0))
    total = F.when(F.col("customer_state").isNull(), F.lit(0)).otherwise(F.col("all_orders"))
    return (g.select("customer_state",
                     big("cancelled").alias("cancelled_order_count"),
                     big(total).alias("total_orders"),
                     percent(F.col("cancelled"), total, scales=(0, 0)).alias("cancellation_rate_percent"))
            .orderBy(F.desc_nulls_last("cancellation_rate_percent"), "customer_state"))
