"""WARC archives: the round trip against plain Python, magic inside payloads, splits, broken files."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tradelens.llm import blocked_bloom, warc


def plain(rows, min_bytes=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of rows (page_id, url, html)."""
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    first: dict = {}
    for i, p in payloads:
        if len(p) >= min_bytes and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in payloads:
        other = len(p) >= min_bytes and p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if other else "response", first[p] if other else None))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit(1) for c in ("file", "split", "pos", "payload", "digest", "first", "key", "record")})


def told(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def odd_pages():
    rng = random.Random(31)
    inner = warc.record(77, "http://in/side", b"<p>inner</p>", None, False).decode() + warc.END
    rows = [(1, "http://a", None), (2, "http://b", ""), (3, None, ""), (4, "http://c\r\nX: y", "<p>é 漢 😀</p>"),
            (5, "http://d", warc.MAGIC), (6, "e", "x" + warc.MAGIC + "y" + warc.MAGIC), (7, "f", inner), (8, "g", inner * 3 + "tail"),
            (9, "h", f"{warc.MAGIC}Content-Length: 999999999\r\n\r\n"), (10, "i", f"{warc.MAGIC}Content-Length: 0\r\n\r\n"),
            (11, "j", "\r\n\r\n\r\n"), (12, "k", "WARC/1.1\r"), (13, "l", "\nWARC/1.1\r\n\r\n"), (14, "m", "long " * 200_000),
            (15, "n", inner), (16, "n", inner), (16, "n", inner), (None, "o", "<b>no id</b>"), (None, "o", "<b>no id</b>"), (None, "p", inner),
            (17, "q", "<b>no id too</b>"), (None, "q", "<b>no id too</b>"), (20, "r", "\x00\x01 zero")]
    rows += [(100 + i, f"http://s/{i}", "same page") for i in range(60)]
    rows += [(1000 + i, f"http://t/{i}", "".join(rng.choice(["a ", "\r\n", warc.MAGIC[:5], warc.MAGIC]) for _ in range(rng.randrange(60)))) for i in range(80)]
    return rows


@pytest.mark.parametrize("split", ["128m", "2000"])
def test_archives_come_back(spark, tmp_path, split):
    rows = odd_pages()
    if split == "2000":  # a split for every 2,000 bytes: without the long page
        rows = [r for r in rows if r[0] != 14][:60]
    folders = warc.write_archives(frame(spark, rows).coalesce(1), str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        back = warc.read_archives(spark, folders)
        assert told(back) == plain(rows)
        got = sorted(((r.page_id, bytes(r.payload)) for r in back.where("record_type = 'response'").collect()), key=str)
        kinds = plain(rows)
        assert len(got) == sum(k[3] == "response" for k in kinds) and {p for _, p in got} == {(h or "").encode() for _, _, h in rows}
        assert told(warc.read_archives(spark, folders, payloads=False)) == kinds
        assert back.select("file", "offset").distinct().count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, "u", h) for i, h in enumerate(["", "", "abc", "abc", "abcdef", "abcdef"])]
    folders = warc.write_archives(frame(spark, rows), str(tmp_path / "w"), min_bytes=5)
    assert told(warc.read_archives(spark, folders)) == plain(rows, 5)


def test_a_full_filter_changes_nothing(spark, tmp_path):
    rows = odd_pages()
    folders = warc.write_archives(frame(spark, rows), str(tmp_path / "w"), filter_bytes=8)
    assert told(warc.read_archives(spark, folders)) == plain(rows)


def test_no_pages(spark, tmp_path):
    folders = warc.write_archives(frame(spark, []), str(tmp_path / "w"))
    assert warc.read_archives(spark, folders).collect() == []


@pytest.mark.parametrize("split", ["128m", "150"])
def test_files_that_others_wrote(spark, tmp_path, split):
    one, two, three = (warc.record(i, "u", f"<p>page {i}</p>".encode() * i, None, False) + b"\r\n\r\n" for i in (1, 2, 3))
    cases = {"good.warc": one + two + three, "cut.warc": one + two + three[:-20], "junk.warc": b"junk" + one,
             "lies.warc": one + two.replace(b"Content-Length: 113", b"Content-Length: 90", 1) + three, "empty.warc": b""}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    assert b"Content-Length: 90" in cases["lies.warc"] or two.count(b"Content-Length") == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        back = warc.read_archives(spark, [str(tmp_path / n) for n in cases])
        got = {(r.file.rsplit("/")[-1], r.offset, r.page_id) for r in back.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {x for x in got if x[0] == "good.warc"} == {("good.warc", 0, 1), ("good.warc", len(one), 2), ("good.warc", len(one + two), 3)}
    assert {x[2] for x in got if x[0] == "cut.warc"} == {1, 2}
    assert not [x for x in got if x[0] in ("junk.warc", "empty.warc")]


def test_filters_miss_nothing(spark):
    keys = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("shard"), F.xxhash64("id").alias("hash"))
    for bits, size in ((16, 64 << 20), (16, 256)):
        filters = blocked_bloom.build(keys, bits, size)
        assert blocked_bloom.size_in_bytes(filters) <= size + 3 * 64
        for shard in range(3):
            own = keys.where(f"shard = {shard}").toArrow()["hash"].to_numpy().view("uint64")
            assert blocked_bloom.may_hold(filters[shard], own).all()
            other = own * 3 + 1
            share = blocked_bloom.may_hold(filters[shard], other).mean()
            assert share < 0.02 if size > 1000 else share > 0.5
    assert blocked_bloom.build(keys.limit(0)) == {}
