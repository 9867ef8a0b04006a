"""The eight marketplace tables ("roles") every report takes as input.

``Roles`` is a bundle of DataFrames. It can be filled from real files with
explicit schemas (:func:`read_roles`) or derived from the TPC-H-style test
tables (:func:`bind_test_tables`). Either way the DataFrames stay lazy: the
reports add joins and aggregates on top and Catalyst pushes filters and column
pruning down into the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.functions.numeric import money

_TS = T.TimestampNTZType()
_MONEY = T.DecimalType(18, 2)

SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("purchase_time", _TS),
        T.StructField("order_approved_at", _TS),
        T.StructField("order_delivered_carrier_date", _TS),
        T.StructField("delivered_time", _TS),
    ]),
    "payments": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("payment_type", T.StringType()),
        T.StructField("payment_installments", T.IntegerType()),
        T.StructField("payment_value", _MONEY),
    ]),
    "items": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("price", _MONEY),
        T.StructField("freight_value", _MONEY),
    ]),
    "products": T.StructType([
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_weight_g", T.DoubleType()),
        T.StructField("product_length_cm", T.DoubleType()),
        T.StructField("product_height_cm", T.DoubleType()),
        T.StructField("product_width_cm", T.DoubleType()),
    ]),
    "translation": T.StructType([
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_category_name_english", T.StringType()),
    ]),
    "customers": T.StructType([
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_unique_id", T.StringType()),
        T.StructField("customer_zip_code_prefix", T.StringType()),
        T.StructField("customer_city", T.StringType()),
        T.StructField("customer_state", T.StringType()),
    ]),
    "sellers": T.StructType([
        T.StructField("seller_id", T.StringType()),
    ]),
    "reviews": T.StructType([
        T.StructField("review_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_comment_title", T.StringType()),
        T.StructField("review_comment_message", T.StringType()),
    ]),
}


class Roles:
    """Input tables of the reports. ``orders`` is the raw table; reports after
    the clean-up step use :attr:`paid_orders`.

    A role may be given as a DataFrame or as a function that makes it: then it is bound when a
    report first asks for it, so a report binds only the roles it reads."""

    def __init__(self, cleaned: DataFrame | Callable[[], DataFrame] | None = None,
                 **roles: DataFrame | Callable[[], DataFrame]):
        if set(roles) != set(SCHEMAS):
            raise TypeError(f"roles missing or unknown: {sorted(set(roles) ^ set(SCHEMAS))}")
        self._given = {**roles, "cleaned": cleaned}  # cleaned: paid_orders as a written table, if a batch made one
        self._bound: dict[str, DataFrame | None] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._given:
            raise AttributeError(name)
        if name not in self._bound:
            given = self._given[name]
            self._bound[name] = given if given is None or isinstance(given, DataFrame) else given()
        return self._bound[name]

    @property
    def paid_orders(self) -> DataFrame:
        if self.cleaned is not None:
            return self.cleaned
        from tradelens.operators.audits import keep_paid_orders

        return keep_paid_orders(self.orders, self.payments)

    def with_(self, **changes: DataFrame) -> "Roles":
        return Roles(**{**self._given, **changes})


def read_roles(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
               **options: str) -> Roles:
    """Read the eight role tables with their declared schemas (no inference). CSV
    has a header and doubled quotes; only review texts may hold line breaks, so
    only that role gives up splitting its files."""
    frames = {}
    for role, schema in SCHEMAS.items():
        csv = {"header": "true", "escape": '"', "multiLine": str(role == "reviews").lower()} if fmt == "csv" else {}
        frames[role] = spark.read.schema(schema).options(**{**csv, **options}).format(fmt).load(paths[role])
    return Roles(**frames)


# Declared schemas of the test tables' columns that the roles are made of: binding them
# reads no file footer and starts no job.
TEST_TABLES = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_returnflag string",
    "supplier": "s_suppkey long",
    "part": "p_partkey long, p_brand string, p_size int",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "documents": "doc_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
}


def _negated(key, every: int):
    """``key``, negated where it is a multiple of ``every``."""
    return F.when(key % every == 0, -key).otherwise(key)


def _days_after(ts: str, days) -> object:
    return F.col(ts) + F.make_dt_interval(days=days.cast("int"))


def bind_test_tables(spark: SparkSession, sf_dir: str) -> Roles:
    """Role tables derived from the TPC-H-style test tables (see FIXTURES.md).

    The rules rename columns and re-key rows; no row of an input table is left
    out, and nothing runs before a report does. Some keys are negated on one
    side only, which makes the orphans the audits look for: payments without
    orders, orders without items and items without product metadata. Some products have a category that no translation knows.
    Customers are one row per checkout, as in the original: most persons check
    out once, the buyers of every fifth order under one person key.
    Every role grows linearly with the input tables.
    """

    def read(name: str) -> DataFrame:
        return spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    ok = F.col("o_orderkey")

    def orders() -> DataFrame:
        return read("orders").select(
            _negated(ok, 97).alias("order_id"),
            ok.alias("customer_id"),
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "O", "shipped")
            .when(F.col("o_orderstatus") == "P", "canceled")
            .alias("order_status"),
            F.col("o_orderdate").alias("purchase_time"),
            _days_after("o_orderdate", ok % 3).alias("order_approved_at"),
            F.when(ok % 23 == 0, F.lit(None))
            .otherwise(_days_after("o_orderdate", ok % 3 + F.expr("o_orderkey div 3") % 14 - 1))
            .alias("order_delivered_carrier_date"),
            F.when(ok % 29 == 0, F.lit(None))
            .otherwise(_days_after("o_orderdate", ok % 61 - 2))
            .alias("delivered_time"),
        )

    def payments() -> DataFrame:
        return read("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_returnflag").alias("payment_type"),
            (F.col("l_linenumber") * 2).alias("payment_installments"),
            money("l_extendedprice").alias("payment_value"),
        )

    def items() -> DataFrame:
        return read("lineitem").select(
            _negated(F.col("l_orderkey"), 89).alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_suppkey") * 200 + F.col("l_orderkey") % 200).alias("seller_id"),
            money("l_extendedprice").alias("price"),
            money("l_quantity").alias("freight_value"),
        )

    def sellers() -> DataFrame:
        # 200 seller accounts per supplier: a fixed fan-out by explode, not a join.
        return (read("supplier")
                .select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
                .select((F.col("s_suppkey") * 200 + F.col("k")).alias("seller_id")))

    brand = F.col("p_brand")

    def products() -> DataFrame:
        size = F.col("p_size")
        return read("part").select(
            _negated(F.col("p_partkey"), 41).alias("product_id"),
            F.when(F.col("p_partkey") % 23 == 0, F.concat(F.lit("Own-"), brand)).otherwise(brand)
            .alias("product_category_name"),
            (size * 100).cast("double").alias("product_weight_g"),
            size.cast("double").alias("product_length_cm"),
            (size + 1).cast("double").alias("product_height_cm"),
            (size + 2).cast("double").alias("product_width_cm"),
        )

    def translation() -> DataFrame:
        return read("part").select(brand.alias("product_category_name")).distinct().select(
            "product_category_name",
            F.lower(F.replace(F.col("product_category_name"), F.lit("#"), F.lit("_")))
            .alias("product_category_name_english"),
        )

    def customers() -> DataFrame:
        # nation is a few KB: Spark's size-checked auto-broadcast picks it up.
        nation = read("nation").select("n_nationkey", "n_name")
        buyers = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return read("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
            ok.alias("customer_id"),
            F.when(ok % 5 == 0, F.col("o_custkey")).otherwise(-ok).alias("customer_unique_id"),
            (F.col("c_custkey") % 50).alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    def reviews() -> DataFrame:
        return read("documents").join(read("labels"), "doc_id", "left").select(
            F.col("doc_id").alias("review_id"),
            F.col("doc_id").alias("order_id"),
            (F.lit(1) + F.col("quality") * 2 + (F.lit(1) - F.col("toxic"))).alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.col("text").alias("review_comment_message"),
        )

    return Roles(orders=orders, payments=payments, items=items, products=products, translation=translation,
                 customers=customers, sellers=sellers, reviews=reviews)
