"""Unit fixtures: one literal table per semantic trap (FIXTURES.md §4)."""

from __future__ import annotations

from decimal import Decimal

from conftest import customer, item, make_roles, order, ts
from pyspark.sql import functions as F

from tradelens.functions.bands import FREIGHT_BANDS, FREIGHT_OTHERWISE, band
from tradelens.operators import audits, customers as cust, freight, payments as pay
from tradelens.operators import products as prod, reviews as rev, sales


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_freight_band_edges_compare_decimals(spark):
    vals = ["9.99", "10.00", "19.99", "20.00", "29.99", "49.99", "50.00", "19.995", None]
    df = spark.createDataFrame([(Decimal(v) if v else None,) for v in vals], "x decimal(10,3)")
    got = [r[0] for r in df.select(band(F.col("x"), FREIGHT_BANDS, FREIGHT_OTHERWISE)).collect()]
    assert got == ["Under 10", "10 - 19.99", "10 - 19.99", "20 - 29.99", "20 - 29.99",
                   "30 - 49.99", "50+", "50+", "50+"]


def test_state_freight_bucket_sums_items_before_banding(spark):
    # 9.99 + 10.00 = 19.99 per order: the SUM is banded, as DECIMAL.
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c1")],
        items=[item("o1", freight="9.99"), item("o1", freight="10.00"),
               item("o2", freight="9.99")],
        customers=[customer("c1", "u1")],
    )
    out = freight.state_freight_bucket_summary(r.items, r.orders, r.customers)
    assert rows(out, "customer_state", "freight_bucket", "order_count") == [
        ("SP", "10 - 19.99", 1), ("SP", "Under 10", 1)]


def test_zero_value_order(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c1")],
        items=[item("o1", price="0.00", freight="5.00"), item("o2", price="10.00", freight="2.00")],
        customers=[customer("c1", "u1")],
    )
    ovf = freight.order_value_vs_freight(r.items, r.orders)
    assert rows(ovf, "order_id", "freight_ratio") == [("o1", None), ("o2", 0.2)]
    by_state = freight.freight_ratio_by_state(r.items, r.orders, r.customers).collect()[0]
    assert by_state["total_orders"] == 2          # counted ...
    assert by_state["avg_freight_ratio"] == 0.2   # ... but skipped in the ratio average
    assert by_state["avg_freight"] == 3.5


def test_negative_delivery_and_midnight_crossing(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1", purchase=ts(5), delivered=ts(4)),
                order("o2", "c1", purchase=ts(0, 23, 59), delivered=ts(1, 0, 1))],
        items=[item("o1"), item("o2")],
        customers=[customer("c1", "u1")],
    )
    dist = freight.delivery_time_distribution(r.orders)
    assert rows(dist, "delivery_band", "orders_in_band") == [("0-5 days", 1), ("21+ days", 1)]
    fbs = freight.freight_by_state(r.items, r.orders, r.customers).collect()
    assert [(x["total_orders"], x["total_delivery_days"]) for x in fbs] == [(1, 1)]


def test_multi_item_order_counts_days_per_item(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1", purchase=ts(0), delivered=ts(10))],
        items=[item("o1"), item("o1"), item("o1")],
        customers=[customer("c1", "u1")],
    )
    x = freight.freight_by_state(r.items, r.orders, r.customers).collect()[0]
    assert (x["total_delivery_days"], x["total_orders"], x["avg_delivery_days"]) == (30, 1, 30.0)


def test_two_reviews_fan_out_revenue(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1")],
        items=[item("o1", price="10.00")],
        reviews=[("r1", "o1", 5, None, None), ("r2", "o1", None, None, None)],
    )
    x = sales.seller_revenue_review_summary(r.items, r.orders, r.reviews).collect()[0]
    assert (x["total_revenue"], x["avg_review_score"], x["review_count"], x["total_orders"]) == \
        (20.0, 5.0, 2, 1)


def test_split_person_and_no_order_customer(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c2")],
        customers=[customer("c1", "u1", state="SP"), customer("c2", "u1", state="RJ"),
                   customer("c3", "u2", state="SP")],
    )
    freq = cust.customer_order_frequency(r.customers, r.orders)
    # one person with 2 orders; the person without orders is in the denominator
    assert rows(freq, "total_orders", "customer_count", "percentage_of_customers") == [(2, 1, 50.0)]
    loyal = cust.state_customer_loyalty(r.customers, r.orders)
    assert rows(loyal, "customer_state", "total_customers", "repeat_customers") == [
        ("RJ", 1, 0), ("SP", 1, 0)]


def test_null_and_untranslated_category(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c1", status="canceled"), order("o3", "c1")],
        items=[item("o1", pid="pn"), item("o3", pid="pu"), item("o2", pid="pn")],
        products=[("pn", None, 1.0, 1.0, 1.0, 1.0), ("pu", "untranslated", 1.0, 1.0, 1.0, 1.0)],
        translation=[("known", "Known")],
        reviews=[("r1", "o1", 4, None, None), ("r3", "o3", 2, None, None)],
    )
    assert sales.category_sales_summary(r.items, r.products, r.translation, r.orders).count() == 0
    crs = rev.category_review_summary(r.reviews, r.orders, r.items, r.products, r.translation)
    assert rows(crs, "category_name", "review_count", "avg_review_score") == [(None, 2, 3.0)]
    canc = prod.cancelled_orders_by_category(r.orders, r.items, r.products, r.translation)
    assert rows(canc, "category_name", "cancelled_order_count") == [(None, 1)]
    sold = prod.most_sold_products(r.items, r.products, r.translation)
    assert rows(sold, "product_id", "total_units_sold") == [("pn", 2), ("pu", 1)]
    single = prod.single_item_orders(r.items, r.orders, r.products, r.translation)
    assert rows(single, "order_id", "product_category_name") == [("o1", None), ("o3", "untranslated")]


def test_high_installments_share_of_all_revenue(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1")],
        payments=[("o1", "card", 6, Decimal("50.00")), ("o1", "card", 7, Decimal("30.00")),
                  ("o1", "card", 12, Decimal("20.00"))],
    )
    out = pay.high_installment_revenue_share(r.payments, r.orders)
    assert rows(out, "payment_installments", "percentage_of_total_revenue") == [(7, 30.0), (12, 20.0)]


def test_quiet_state_absent_from_cancellation_rates(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1", status="canceled"), order("o2", "c1"), order("o3", "c2")],
        customers=[customer("c1", "u1", state="AC"), customer("c2", "u2", state="SP")],
    )
    out = prod.cancelled_orders_by_state(r.orders, r.customers)
    assert rows(out, "customer_state", "cancelled_order_count", "total_orders",
                "cancellation_rate_percent") == [("AC", 1, 2, 50.0)]


def test_review_texts_non_blank(spark):
    r = make_roles(spark, reviews=[
        ("r1", "o1", 1, None, None), ("r2", "o2", 2, "", "  "), ("r3", "o3", 3, "ok", None),
        ("r4", "o4", 4, None, "bom"), ("r5", "o5", None, "a", "b")])
    out = rev.review_text_by_score(r.reviews)
    assert rows(out, "full_review_text") == [(" bom",), ("a b",), ("ok ",)]


def test_repeat_gaps_telescoped_equals_lag(spark):
    r = make_roles(
        spark,
        orders=[order("a1", "ca", purchase=ts(0)), order("a2", "ca", purchase=ts(10)),
                order("a3", "ca", purchase=ts(30)), order("b1", "cb", purchase=ts(0)),
                order("b2", "cb", purchase=ts(5)), order("c1", "cc", purchase=ts(3))],
        items=[item(o) for o in ["a1", "a2", "a3", "b1", "b2", "c1"]],
        customers=[customer("ca", "A"), customer("cb", "B"), customer("cc", "C")],
    )
    gaps = cust.order_gaps(r.orders, r.customers).where(F.col("prev_purchase_time").isNotNull())
    lag_days = rows(gaps.select("customer_unique_id",
                                F.datediff("purchase_time", "prev_purchase_time").alias("d")),
                    "customer_unique_id", "d")
    assert lag_days == [("A", 10), ("A", 20), ("B", 5)]
    per = cust.repeat_customer_gaps(r.orders, r.customers, r.items)
    assert rows(per, "customer_unique_id", "avg_days_between_orders") == [("A", 15.0), ("B", 5.0)]
    stats = cust.repeat_customer_order_stats(r.orders, r.customers, r.items)
    assert rows(stats, "total_orders", "customers", "avg_days_between_orders") == [
        (2, 1, 5.0), (3, 1, 15.0)]


def test_one_time_persons_count_item_rows(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c2"), order("o3", "c2")],
        items=[item("o1", pid="p1"), item("o1", pid="p1"), item("o2"), item("o3")],
        customers=[customer("c1", "u1"), customer("c2", "u2")],
    )
    out = cust.one_time_customer_product_distribution(r.customers, r.orders, r.items)
    assert rows(out, "products_in_order", "customer_count") == [(2, 1)]


def test_paid_orders_and_orphans(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c1")],
        payments=[("o1", "card", 1, Decimal("1.00")), ("o9", "card", 1, Decimal("2.00"))],
    )
    assert rows(r.paid_orders, "order_id") == [("o1",)]
    assert rows(audits.payments_without_orders(r.payments, r.orders), "order_id") == [("o9",)]
    assert audits.orders_without_payments_count(r.orders, r.payments).collect()[0][0] == 1


def test_late_delivery_band_holds_21_to_30(spark):
    r = make_roles(spark, orders=[
        order("o1", "c", purchase=ts(0), delivered=ts(20)),
        order("o2", "c", purchase=ts(0), delivered=ts(21)),
        order("o3", "c", purchase=ts(0), delivered=ts(60)),
        order("o4", "c", purchase=ts(0), delivered=ts(2))])
    out = audits.late_delivery_bands(r.orders)
    assert rows(out, "delivery_band", "orders_in_band", "percent_of_total") == [
        ("20-30 days", 1, 25.0), ("51+ days", 1, 25.0)]


def test_a_null_person_is_never_a_one_time_customer(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c2")],
        items=[item("o1"), item("o2"), item("o2")],
        customers=[customer("c1", None), customer("c2", "u2")],
    )
    out = cust.one_time_customer_product_distribution(r.customers, r.orders, r.items)
    assert rows(out, "products_in_order", "customer_count") == [(2, 1)]


def test_gaps_of_a_null_person_over_many_partitions(spark):
    r = make_roles(
        spark,
        orders=[order(f"o{i:03}", "c1", purchase=ts(i % 40, i % 24, i % 7)) for i in range(200)]
        + [order("z1", "c1", purchase=None), order("z2", "c2", purchase=ts(3))],
        customers=[customer("c1", None), customer("c2", "u2")],
    )
    orders = r.orders.withColumn("purchase_time", F.when(F.col("order_id") != "z1", F.col("purchase_time")))
    want = {}
    times = sorted((ts(i % 40, i % 24, i % 7), f"o{i:03}") for i in range(200))
    for before, (t, oid) in zip([(None, "z1"), *times], times):
        want[oid] = before[0]
    want |= {"z1": None, "z2": None}
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            gaps = cust.order_gaps(orders.repartition(6), r.customers).collect()
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert {g["order_id"]: g["prev_purchase_time"] for g in gaps} == want


def test_orphans_with_and_without_a_key(spark):
    r = make_roles(
        spark,
        orders=[order("o1", "c1"), order("o2", "c9"), order("o3", "c9")],
        payments=[("o1", "card", 1, Decimal("1.00")), ("x", "card", 1, Decimal("1.00")),
                  ("x", "card", 1, Decimal("1.00")), (None, "card", 1, Decimal("2.00"))],
        items=[item("o1", "p1"), item("o2", "gone"), item("o2", None), item("o3", None)],
        products=[("p1", "cat", 1.0, 1.0, 1.0, 1.0)],
        customers=[customer("c1", "u1")],
    )
    got = audits.payments_without_orders(r.payments, r.orders).collect()
    assert sorted(str(x["order_id"]) for x in got) == ["None", "x", "x"]
    assert audits.orders_with_unmatched_products(r.items, r.products).collect()[0][0] == 2
    assert audits.orders_with_unknown_customer(r.orders, r.customers).collect()[0][0] == 1
