"""CSV sources with a quarantine: counts add up, good rows do not change."""

from __future__ import annotations

import pytest
from conftest import customer, make_roles, order
from pyspark.sql import types as T

from tradelens.__main__ import main
from tradelens.sources.files import REVIEW_TEXT_SCHEMA, read_csv, write_csv
from tradelens.sources.quarantine import FIELDS, read_csv_checked, read_roles_checked
from tradelens.sources.roles import SCHEMAS

TYPED = T.StructType().add("id", "long").add("at", "timestamp_ntz").add("price", T.DecimalType(18, 2)).add("note", "string")


def written(tmp_path, text, name="part.csv"):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_good_rows_unchanged(spark, tmp_path):
    data = [(5, 'a "q", b\nline2'), (3, " "), (None, "x"), (1, None), (3, " ")]
    path = str(tmp_path / "text")
    write_csv(spark.createDataFrame(data, REVIEW_TEXT_SCHEMA), path)
    checked = read_csv_checked(spark, path, REVIEW_TEXT_SCHEMA)
    assert rows(checked.good) == rows(read_csv(spark, path)) == sorted(data, key=str)
    assert checked.good.schema == read_csv(spark, path).schema
    assert checked.rejected.count() == 0


def test_every_fault_has_file_and_reason(spark, tmp_path):
    path = written(tmp_path, 'id,at,price,note\n1,2020-01-01 10:00:00,2.50,ok\none,,,\n2,yesterday,,\n'
                             '3,,1e99,\n4,2020-01-01,1\n5,,,a,b\n 6 ,,,\n,,,\n')
    checked = read_csv_checked(spark, path, TYPED)
    assert [r[0] for r in checked.good.orderBy("id").collect()] == [None, 1, 6]
    found = {r.record: r.reason for r in checked.rejected.collect()}
    assert found == {"one,,,": "id: not a bigint", "2,yesterday,,": "at: not a timestamp_ntz",
                     "3,,1e99,": "price: not a decimal(18,2)", "4,2020-01-01,1": FIELDS, "5,,,a,b": FIELDS}
    assert {r.file.rsplit("/", 1)[1] for r in checked.rejected.collect()} == {"part.csv"}


@pytest.mark.parametrize("lines", ["true", "false"])
def test_rows_do_not_depend_on_the_columns_asked_for(spark, tmp_path, lines):
    path = written(tmp_path, "id,at,price,note\n1,,,a\nx,,,b\n2,,zero,c\n3,\n")
    checked = read_csv_checked(spark, path, TYPED, multiLine=lines)
    assert checked.good.count() == 1 and checked.rejected.count() == 3
    for name in TYPED.fieldNames():
        assert checked.good.select(name).count() == 1
        assert len(checked.good.select(name).collect()) == 1


@pytest.mark.parametrize("names", [["a", "b"], ["_broken", "_WHY"], ["a.b", "c`d"]])
def test_text_columns_only_and_clashing_names(spark, tmp_path, names):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    path = written(tmp_path, 'h1,h2\n"line\nbreak",y\nonly\n,\n"",z\n')
    checked = read_csv_checked(spark, path, schema)
    assert checked.good.columns == names
    assert rows(checked.good) == sorted([("line\nbreak", "y"), (None, None), (None, "z")], key=str)
    assert checked.good.count() == 3 and checked.rejected.count() == 1
    assert checked.rejected.collect()[0].record == "only"


def test_empty_files_and_very_long_fields(spark, tmp_path):
    empty = read_csv_checked(spark, written(tmp_path, ""), REVIEW_TEXT_SCHEMA)
    assert empty.good.count() == 0 and empty.rejected.count() == 0
    long = "word, " * 400_000
    checked = read_csv_checked(spark, written(tmp_path, f's,t\n1,"{long}"\nno,"{long}"\n1,"{long}",2\n'), REVIEW_TEXT_SCHEMA)
    assert checked.good.collect()[0].full_review_text == long
    assert sorted(r.reason for r in checked.rejected.collect()) == [FIELDS, "review_score: not a int"]
    assert all(len(r.record) > len(long) for r in checked.rejected.collect())


def test_roles_and_command_line(spark, tmp_path):
    r = make_roles(spark, orders=[order("o1", "c1"), order("o2", "c2")], customers=[customer("c1", "p1"), customer("c2", "p2")])
    paths = {}
    for role in SCHEMAS:
        paths[role] = str(tmp_path / "roles" / role)
        getattr(r, role).write.option("header", "true").csv(paths[role])
    (tmp_path / "roles" / "customers" / "late.csv").write_text(
        ",".join(SCHEMAS["customers"].fieldNames()) + "\nc3,p3\n", encoding="utf-8")
    roles, rejects = read_roles_checked(spark, paths)
    assert roles.customers.count() == 2 and roles.orders.count() == 2
    assert [(x.role, x.reason, x.record) for x in rejects.collect()] == [("customers", FIELDS, "c3,p3")]
    assert main(["--roles", str(tmp_path / "roles"), "--out", str(tmp_path / "out"), "--format", "csv",
                 "--rejects", str(tmp_path / "rejects"), "--reports", "order_status_histogram"]) == 0
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1
    with pytest.raises(SystemExit):
        main(["--roles", "x", "--out", "y", "--rejects", "z"])
