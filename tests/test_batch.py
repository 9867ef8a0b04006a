from __future__ import annotations

import os
from decimal import Decimal

import pytest
from conftest import make_roles, order

from tradelens.plans.batch import materialise_roles, run_reports
from tradelens.plans.catalog import REPORTS
from tradelens.sources.roles import SCHEMAS, bind_test_tables

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_bucketed_roles_give_the_same_reports(spark, tmp_path):
    raw = bind_test_tables(spark, SF)
    mat = materialise_roles(spark, raw, 4, str(tmp_path / "roles"))
    names = ["seller_revenue_review_summary", "state_freight_bucket_summary",
             "repeat_customer_order_stats", "cancelled_orders_by_state"]
    for name in names:
        a = sorted(tuple(r) for r in REPORTS[name](raw, spark).collect())
        b = sorted(tuple(r) for r in REPORTS[name](mat, spark).collect())
        assert a == b, name
    written = run_reports(spark, mat, str(tmp_path / "out"), names, concurrent_jobs=2)
    assert written == names
    assert spark.read.parquet(str(tmp_path / "out" / names[0])).count() > 0


def test_read_roles_with_declared_schemas(spark, tmp_path):
    from tradelens.operators import sales
    from tradelens.sources.roles import read_roles

    r = make_roles(spark, orders=[order("o1", "c1")],
                   payments=[("o1", "card", 2, Decimal("12.34"))])
    paths = {}
    for role in SCHEMAS:
        paths[role] = str(tmp_path / role)
        getattr(r, role).write.option("header", "true").csv(paths[role])
    back = read_roles(spark, paths, fmt="csv", header="true")
    assert back.payments.schema == SCHEMAS["payments"]
    out = sales.monthly_orders_revenue_summary(
        sales.merged_orders_payments(back.paid_orders, back.payments)).collect()
    assert [tuple(x) for x in out] == [("2020-01", 12.34, 1, 12.34)]


def test_cluster_settings_size_partitions_to_the_target():
    from tradelens.session import cluster_settings

    s = cluster_settings(20 << 40, executors=1000, cores_per_executor=8)
    parts = int(s["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and (20 << 40) / parts <= 256 << 20
    assert s["spark.sql.adaptive.enabled"] == "true"
    small = cluster_settings(1 << 20, executors=2, cores_per_executor=4)
    assert small["spark.sql.shuffle.partitions"] == "8"


def test_command_line_runs_reports_over_role_files(spark, tmp_path):
    from tradelens.__main__ import main

    r = make_roles(spark, orders=[order("o1", "c1"), order("o2", "c1", status="canceled")],
                   payments=[("o1", "card", 2, Decimal("12.34"))],
                   customers=[("c1", "u1", "01000", "x", "SP")])
    for role in SCHEMAS:
        getattr(r, role).write.option("header", "true").csv(str(tmp_path / "roles" / role))
    out = tmp_path / "out"
    assert main(["--roles", str(tmp_path / "roles"), "--out", str(out), "--format", "csv",
                 "--reports", "monthly_orders_revenue_summary,cancelled_orders_by_state"]) == 0
    monthly = spark.read.parquet(str(out / "monthly_orders_revenue_summary")).collect()
    assert [tuple(x) for x in monthly] == [("2020-01", 12.34, 1, 12.34)]
    assert spark.read.parquet(str(out / "cancelled_orders_by_state")).count() == 0
