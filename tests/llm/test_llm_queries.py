"""The registered queries against their SQL or a brute-force version, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest
from helpers import SF, brute_components
from test_llm_language_packing import check_packed
from test_llm_scan import brute_contaminated, brute_licenses

import corpus_pipeline
from tradelens.llm import license_scan, simhash_dedup
from tradelens.llm.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == sorted(df.columns)
    order = [expected.columns.index(c) for c in df.columns]
    got = sorted(tuple(map(str, r)) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in order) for r in expected.fetchall()) and got


def documents(duck):
    return duck.sql("select doc_id, text from documents order by doc_id").fetchall()


def test_near_duplicates_against_all_pairs(spark, duck):
    fps = {i: simhash_dedup.fingerprint(t or "", 3, 42) for i, t in documents(duck)}
    roots = brute_components(fps, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (format(fps[i], "016x"), roots[i]) for i in fps}


def test_decontamination_against_all_windows(spark, duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    got = {(r.doc_id, r.item_id): round(r.similarity, 12) for r in QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    assert got == {k: round(v, 12) for k, v in brute_contaminated(documents(duck), items).items()} and got


def test_licenses_against_all_stretches(spark, duck):
    got = {(r.doc_id, r.template_id) for r in QUERIES["op3_license_scan"](spark, SF).collect()}
    assert got == set(brute_licenses(documents(duck), list(license_scan.NOTICES.items()))) and got


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_against_plain_steps(spark, duck):
    rows = documents(duck)
    kept = {}
    for i, t in rows:  # every text here has letters and a clear language
        kept[t] = max(i, kept.get(t, i))
    rows = sorted((i, t) for t, i in kept.items())
    roots = brute_components({i: simhash_dedup.fingerprint(t, 3, 42) for i, t in rows}, 3)
    rows = [(i, t) for i, t in rows if roots[i] == i]
    leaked = {i for i, _ in brute_contaminated(rows, duck.sql("select item_id, text from benchmark").fetchall())}
    rows = [(i, t) for i, t in rows if i not in leaked]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert check_packed(rows, pieces, 1024) > 0.95 and leaked


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == empty.columns and out.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
