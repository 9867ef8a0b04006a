"""Safe replacement and partition-scoped deletes of stored tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradelens.sources.versioned import VersionedTable, WriteConflict


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_and_old_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.manifest() is None and table.versions() == []
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(5), info={"by": "first"})
    table.replace(spark.range(3).withColumn("x", F.lit("a")))
    assert rows_of(table.read()) == [(0, "a"), (1, "a"), (2, "a")]
    assert rows_of(table.read(1)) == [(i,) for i in range(5)]
    assert table.manifest(1).info == {"by": "first"}
    assert len(table.vacuum()) == 1 and table.versions() == [2]
    assert rows_of(table.read()) == [(0, "a"), (1, "a"), (2, "a")]
    table.replace(spark.range(0))
    assert rows_of(table.read()) == []
    table.drop()
    assert table.manifest() is None


def test_a_job_that_ends_half_way_leaves_the_old_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(100).repartition(4))
    reader = table.read()
    broken = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert table.versions() == [1] and rows_of(table.read()) == rows_of(reader) == sorted([(i,) for i in range(100)], key=str)
    left = set(table._files.names("data")) - {table.manifest().parts[""].split("/")[1]}
    assert set(table.vacuum()) == left
    assert table.read().count() == 100


def test_a_driver_lost_before_publishing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(10))
    with monkeypatch.context() as m:
        m.setattr(type(table._files), "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.replace(spark.range(99))
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.read().count() == 10 and len(again.vacuum()) == 1


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.replace(spark.range(1))
    before = two.manifest()
    one.replace(spark.range(2))
    with pytest.raises(WriteConflict):
        two._publish(before, before.schema, before.parts, None, None)
    assert one.read().count() == 2 and not [n for n in one._files.names("versions") if n.startswith(".")]


def dated(spark, rows):
    return spark.createDataFrame([(i, None if d is None else dt.date(2020, d, 1), x) for i, d, x in rows], "id long, day date, x string")


MONTH = "date_format(day, 'yyyy/MM')"  # the slash has to be escaped in a folder's name


def test_a_delete_rewrites_only_partitions_that_hold_deleted_rows(spark, tmp_path):
    rows = [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, None), (None, 3, "n"), (6, 3, "d"), (7, None, "u"), (8, None, "v"), (9, 4, "w"), (9, 4, "w")]
    table = VersionedTable(spark, str(tmp_path / "t"))
    first = table.replace(dated(spark, rows), partition_by=MONTH)
    assert set(first.parts) == {"2020/01", "2020/02", "2020/03", "2020/04", "__HIVE_DEFAULT_PARTITION__"}
    assert rows_of(table.read()) == rows_of(dated(spark, rows))
    assert rows_of(table.read(labels=["2020/02"])) == rows_of(dated(spark, rows[2:4]))
    keys = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 6, 7, None)], "id long")
    report = {r.label: (r.rows_before, r.rows_deleted, r.rewritten) for r in table.delete_unmatched(keys, "id").collect()}
    assert report == {"2020/01": (2, 0, False), "2020/02": (2, 1, True), "2020/03": (2, 1, True), "2020/04": (2, 2, True), None: (2, 1, True)}
    assert rows_of(table.read()) == rows_of(dated(spark, [rows[k] for k in (0, 1, 2, 5, 6)]))
    after = table.manifest()
    assert after.parts["2020/01"] == first.parts["2020/01"] and "2020/04" not in after.parts
    assert rows_of(table.read(1)) == rows_of(dated(spark, rows))
    # nothing to delete: no new version
    assert table.delete_unmatched(keys, "id").where("rewritten").count() == 0 and table.versions() == [1, 2]
    table.vacuum()
    assert table.read().count() == 5


def test_a_delete_from_a_table_without_partitions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(10))
    report = table.delete_unmatched(spark.range(0, 10, 2), "id").collect()
    assert [tuple(r) for r in report] == [("", 10, 5, True)]
    assert rows_of(table.read()) == [(i,) for i in range(0, 10, 2)]
