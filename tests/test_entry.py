"""The entry module loads without any Spark jar and without the optional parts."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

NO_JARS = """
import glob, zipfile
def refuse(*a, **k):
    raise AssertionError("the entry module must not look for jars")
glob.glob = glob.iglob = refuse
zipfile.ZipFile = refuse
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(o) >= 70 and set(o) <= set(q), (len(o), set(o) - set(q))
print("ok", len(q))
"""

WITHOUT_EXTRAS = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline",) or name.startswith("tradelens.llm"):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "monthly_orders_revenue_summary" in q and not any(n.startswith("op") and n[2].isdigit() for n in q)
print("ok", len(q))
"""


def _run(code: str) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
                          timeout=120, env={**os.environ, "PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_entry_loads_without_spark_jars():
    assert _run(NO_JARS).startswith("ok")


def test_entry_loads_without_the_optional_parts():
    assert _run(WITHOUT_EXTRAS).startswith("ok")
