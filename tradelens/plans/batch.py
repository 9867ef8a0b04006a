"""Run many reports as one batch, the way the original script runs them.

1. The role tables are written once into a shared folder the caller names:
   the order-keyed roles (orders, cleaned orders, payments, items, reviews)
   bucketed and sorted on ``order_id``, customers on ``customer_id``. Every
   later join on those keys reads co-partitioned buckets instead of shuffling
   both sides, and the lineage of all reports is cut at these tables: a lost
   executor recomputes from them, not from the raw inputs.
2. Each report is written with overwrite semantics (the original's DROP TABLE
   IF EXISTS + CREATE TABLE AS) to ``out_dir/<report name>``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tradelens.plans.catalog import REPORTS
from tradelens.sources.files import write_table
from tradelens.sources.roles import Roles

_ORDER_KEYED = ("orders", "payments", "items", "reviews")


def materialise_roles(spark: SparkSession, roles: Roles, buckets: int, folder: str,
                      database: str | None = None) -> Roles:
    """Write the roles (and the cleaned orders) as bucketed tables under
    ``folder``, which every executor must reach, and return Roles that read them
    back. The tables stay until the caller drops ``database``."""
    db = database or f"tradelens_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{folder.rstrip('/')}/{db}'")

    def save(df: DataFrame, name: str, key: str | None) -> DataFrame:
        table = f"{db}.{name}"
        w = df.write.mode("overwrite").format("parquet")
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(table)
        return spark.table(table)

    out = {}
    for role in ("orders", "payments", "items", "products", "translation", "customers",
                 "sellers", "reviews"):
        key = "order_id" if role in _ORDER_KEYED else ("customer_id" if role == "customers"
                                                        else None)
        out[role] = save(getattr(roles, role), role, key)
    out["cleaned"] = save(roles.paid_orders, "paid_orders", "order_id")
    return Roles(**out)


def run_reports(spark: SparkSession, roles: Roles, out_dir: str,
                names: Iterable[str] | None = None, concurrent_jobs: int = 1) -> list[str]:
    """Write each named report (default: all) to ``out_dir/<name>``.

    With ``concurrent_jobs > 1`` the reports are submitted from that many
    driver threads, so the small final stages of some reports overlap with
    the scans of others instead of leaving executors idle (pair it with
    ``spark.scheduler.mode=FAIR`` on a shared cluster)."""
    todo = list(names or REPORTS)

    def one(name: str) -> str:
        write_table(REPORTS[name](roles, spark), f"{out_dir.rstrip('/')}/{name}")
        return name

    if concurrent_jobs <= 1:
        return [one(n) for n in todo]
    with ThreadPoolExecutor(max_workers=concurrent_jobs) as pool:
        return list(pool.map(one, todo))
