"""Physical-plan summary of every registered query, as a Markdown table.

usage: python tools/plan_report.py [sf_dir] > PLANS.md

For each query: exchanges (shuffles), join strategies, windows and Python
evaluation nodes in the final adaptive plan at the given scale, and the
number of exchanges when no side may be broadcast -- the shape the plan takes
when every table is large.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradelens.plans.catalog import REGISTRY  # noqa: E402
from tradelens.session import local_session  # noqa: E402

APPENDIX = ["monthly_orders_revenue_summary", "seller_revenue_review_summary",
            "review_word_frequency_by_score"]
EXCHANGE = re.compile(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)")


def shape(plan: str) -> dict[str, int]:
    return {
        "exchanges": len(EXCHANGE.findall(plan)),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "semi/anti": len(re.findall(r"LeftSemi|LeftAnti", plan)),
        "window": len(re.findall(r"\bWindow \[", plan)) + plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas", plan)),
        "cartesian": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    rows = []
    formatted = {}
    for name, fn in REGISTRY.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        final = shape(df._jdf.queryExecution().executedPlan().toString())
        rows.append((name, final))
        if name in APPENDIX:
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain("formatted")
            formatted[name] = buf.getvalue()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    large = {name: shape(fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
             for name, fn in REGISTRY.items()}
    print(f"# Physical plans at {sf_dir} (local[*], AQE on)\n")
    print("Columns from the final adaptive plan; the last column counts exchanges when")
    print("broadcasting is disabled (every table treated as large).\n")
    print("| query | exchanges | broadcast joins | sort-merge joins | semi/anti | windows |"
          " python nodes | cartesian | exchanges, no broadcast |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, s in rows:
        print(f"| {name} | {s['exchanges']} | {s['bhj']} | {s['smj']} | {s['semi/anti']} |"
              f" {s['window']} | {s['python']} | {s['cartesian']} | {large[name]['exchanges']} |")
    for name, text in formatted.items():
        print(f"\n## `{name}`: explain(\"formatted\") after execution\n")
        print("```")
        print(text.rstrip())
        print("```")


if __name__ == "__main__":
    main()
