"""The dependency graph: shared joins are made once, only dependants are rebuilt."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tradelens.plans import derived
from tradelens.plans.catalog import REPORTS
from tradelens.sources.roles import SCHEMAS, bind_test_tables

SF = "/root/testdata/sf0.001"
SOLD = ["monthly_category_revenue", "category_sales_summary", "seller_total_revenue", "seller_revenue_review_summary",
        "sellers_with_only_unfulfilled_orders"]
OTHERS = ["monthly_orders_revenue_summary", "time_range", "cancelled_orders_by_state"]


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_fingerprints_follow_the_rows(spark):
    one = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (2, None, 3.0)], "a int, b string, c double")
    same = derived.row_fingerprint(one)
    assert derived.row_fingerprint(one.orderBy(F.desc("a")).repartition(3)) == same
    for other in (one.distinct(), one.limit(2), one.withColumn("b", F.coalesce("b", F.lit(""))), one.withColumnRenamed("b", "x"),
                  one.withColumn("a", F.col("a").cast("long")), one.limit(0)):
        assert derived.row_fingerprint(other) != same


def test_only_dependants_are_rebuilt(spark, tmp_path):
    built = []

    def made(name, fn):
        def build(**given):
            built.append(name)
            return fn(**given)
        return build

    nodes = [derived.Node("d", ("b", "c"), made("d", lambda b, c: b.join(c, "id"))), derived.Node("b", ("x",), made("b", lambda x: x.withColumn("p", F.col("id") * 2))),
             derived.Node("c", ("x", "y"), made("c", lambda x, y: x.join(y, "id"))), derived.Node("e", ("y",), made("e", lambda y: y))]
    tables = derived.DerivedTables(spark, str(tmp_path), nodes)
    x, y = spark.range(10), spark.range(5, 15)
    assert tables.refresh({"x": x, "y": y}) == {"b": "built", "c": "built", "d": "built", "e": "built"} and built == ["b", "c", "d", "e"]
    assert set(tables.refresh({"x": x.repartition(3), "y": y}).values()) == {"kept"} and len(built) == 4
    assert tables.refresh({"x": x, "y": spark.range(5, 16)}) == {"b": "kept", "c": "built", "d": "built", "e": "built"}
    assert tables.refresh({"x": spark.range(11), "y": spark.range(5, 16)}) == {"b": "built", "c": "built", "d": "built", "e": "kept"}
    assert rows_of(tables.read("d")) == sorted((str(i), str(2 * i)) for i in range(5, 11))
    assert tables.refresh({"x": spark.range(12)}, ["b"]) == {"b": "built"}  # what is not needed is not read


def test_a_lost_run_goes_on_where_it_ended(spark, tmp_path):
    broken = [True]

    def last(b):
        if broken[0]:
            raise RuntimeError("lost")
        return b

    nodes = [derived.Node("b", ("x",), lambda x: x), derived.Node("c", ("b",), last)]
    tables = derived.DerivedTables(spark, str(tmp_path), nodes)
    with pytest.raises(RuntimeError):
        tables.refresh({"x": spark.range(3)})
    broken[0] = False
    assert tables.refresh({"x": spark.range(3)}) == {"b": "kept", "c": "built"}


def test_circles_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="circle"):
        derived.DerivedTables(spark, str(tmp_path), [derived.Node("a", ("b",), lambda b: b), derived.Node("b", ("a",), lambda a: a)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_reports_share_the_join_of_the_items(spark, tmp_path):
    roles = bind_test_tables(spark, SF)
    names = SOLD + OTHERS
    tables = derived.report_tables(spark, roles, str(tmp_path), names)
    assert [n for n in tables._order(names) if "items" in tables.nodes[n].inputs] == ["ordered_items"]
    first = derived.refresh_reports(spark, roles, str(tmp_path), names)
    assert set(first.values()) == {"built"} and set(names) <= set(first)
    for name in names:
        assert rows_of(tables.read(name)) == rows_of(REPORTS[name](roles, spark)), name
    stored = tables.read("ordered_items")
    assert all(str(tmp_path) in f for f in derived.sales.seller_total_revenue_of(stored).inputFiles())
    changed = roles.with_(reviews=roles.reviews.withColumn("review_score", F.lit(3)))
    second = derived.refresh_reports(spark, changed, str(tmp_path), names)
    assert {n for n, what in second.items() if what == "built"} == {"seller_revenue_review_summary"}
    assert rows_of(tables.read("seller_revenue_review_summary")) == rows_of(REPORTS["seller_revenue_review_summary"](changed, spark))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_every_report_names_the_roles_it_reads(spark, tmp_path):
    roles = bind_test_tables(spark, SF)
    tables = derived.report_tables(spark, roles, str(tmp_path), [n for n in REPORTS if "csv" not in n])
    for name, node in tables.nodes.items():
        assert node.inputs and set(node.inputs) <= {*SCHEMAS, *tables.nodes}, name
