"""Run the report pack over your own role tables.

    python -m tradelens --roles DIR --out OUT [--format parquet|csv]
                        [--reports name,name,...] [--buckets N] [--jobs K] [--list]

DIR holds one folder (or file) per role: orders, payments, items, products,
translation, customers, sellers, reviews -- read with the declared schemas of
``sources.roles.SCHEMAS`` (CSV with a header row). Every report is written as
Parquet to OUT/<report name>, replacing what was there (the original script's
DROP TABLE + CREATE TABLE AS). ``--buckets N`` first writes the roles as
order_id-bucketed tables in the shared folder so the order-keyed joins
of all reports run without shuffling those tables again.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tradelens.plans.batch import materialise_roles, run_reports
from tradelens.plans.catalog import REPORTS
from tradelens.session import SQL_DEFAULTS, shared_folder
from tradelens.sources.quarantine import read_roles_checked
from tradelens.sources.roles import SCHEMAS, read_roles


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m tradelens", description=__doc__.split("\n\n")[0])
    p.add_argument("--roles", help="directory with one entry per role")
    p.add_argument("--out", help="output directory for the reports")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    p.add_argument("--rejects", help="with csv: put records that do not fit the schemas here and go on without them")
    p.add_argument("--reports", default="", help="comma-separated report names (default: all)")
    p.add_argument("--buckets", type=int, default=0, help="bucket the roles on order_id first")
    p.add_argument("--jobs", type=int, default=1, help="reports submitted concurrently")
    p.add_argument("--list", action="store_true", help="print the report names and exit")
    args = p.parse_args(argv)
    if args.list:
        print("\n".join(REPORTS))
        return 0
    if not args.roles or not args.out:
        p.error("--roles and --out are required")
    if args.rejects and args.format != "csv":
        p.error("--rejects needs --format csv")
    names = [n for n in args.reports.split(",") if n] or list(REPORTS)
    unknown = [n for n in names if n not in REPORTS]
    if unknown:
        p.error(f"unknown reports: {', '.join(unknown)}")

    builder = SparkSession.builder.appName("tradelens")
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    paths = {r: f"{args.roles.rstrip('/')}/{r}" for r in SCHEMAS}
    if args.rejects:
        roles, rejects = read_roles_checked(spark, paths)
        rejects.write.mode("overwrite").partitionBy("role").parquet(args.rejects)
    else:
        roles = read_roles(spark, paths, fmt=args.format)
    if args.buckets:
        roles = materialise_roles(spark, roles, args.buckets, shared_folder(spark))
    for name in run_reports(spark, roles, args.out, names, concurrent_jobs=args.jobs):
        print(f"wrote {args.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
