"""WARC archives, written and read back by boundary-chain verification.

*Writing.* Pages become records: of pages with one payload that with the smallest
page_id is a response, the others are revisits that refer to it and carry no payload.
Which payloads come more than once is found from digests alone; a blocked
Bloom filter over those (bounded in size) is broadcast, so a page that shares its payload
with none is written where it is scanned, and only the rest meets the table of
shared payloads in a join. Spark's own text writer commits the files.

*Reading.* Archives are read in splits, cut at the magic ``WARC/1.1`` wherever it
stands. Every task reports its candidates: where a segment begins and where,
if it is a record, its successor must begin. A payload may hold the magic, even a whole
well-formed record, so candidates prove nothing. Inside a split every candidate
is followed to where its chain leaves the split; between splits, pointer jumping
from the file's start doubles the known part of the chain with every round (log2 of
the splits of a file). What the chain does not reach is payload. Records that
hold the magic are put together again from their segments.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.llm import blocked_bloom
from tradelens.llm.common import cut, map_arrow, small_or_shuffled

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_MAGIC, _END = MAGIC.encode(), END.encode()
RECORD_ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing --------------------------------------------------------------


def _header_value(text: str) -> str:
    """Control characters cannot stand in a header; they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record without its closing two line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
             f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{RECORD_ID}{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC.encode() + "\r\n".join(lines).encode("utf-8", "replace") + _END + block


_ROW = "page_id long, url string, payload binary, digest binary, key long"


def _pages(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    return rows.withColumn("key", F.xxhash64("digest"))


def shared_payloads(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, key, first): payloads of at least ``min_bytes`` bytes that several rows
    have, with the smallest page_id."""
    return (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest", "key")
            .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "key", "first"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, filter_bytes: int = 64 << 20) -> list[str]:
    """Archives of ``pages`` (page_id, url, html; other columns are ignored) under
    ``folder``; the folders written.

    A null html is an empty payload. Rows that share page_id and payload are one
    page: all are responses or all refer to the same one. A row without page_id
    is never the first; if no row of a payload has one, all are responses.
    """
    spark, rows = pages.sparkSession, _pages(pages)
    shared = cut(shared_payloads(rows, min_bytes))
    filters = spark.sparkContext.broadcast(blocked_bloom.build(
        shared.select(F.lit(0).alias("shard"), F.col("key").alias("hash")), max_bytes=filter_bytes))

    def held(batch: pa.RecordBatch) -> np.ndarray:
        blocks = filters.value.get(0)
        keys = batch.column("key").to_numpy().view(np.uint64)
        return np.zeros(len(keys), bool) if blocks is None else blocked_bloom.may_hold(blocks, keys)

    def alone(batches):
        for batch in batches:
            own = batch.filter(pa.array(~held(batch)))
            yield _records(own, [None] * own.num_rows, [False] * own.num_rows)

    def suspects(batches):
        for batch in batches:
            yield batch.filter(pa.array(held(batch)))

    def decided(batches):
        for batch in batches:
            yield _records(batch, batch.column("first").to_pylist(), batch.column("revisit").to_pylist())

    written = [_write(map_arrow(rows, alone, "record binary"), f"{folder}/alone")]
    if filters.value:
        revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
        # two plain shuffles, which adaptive execution splits for a payload that many pages have
        met = (map_arrow(rows, suspects, _ROW).drop("key").join(shared.drop("key"), "digest", "left")
               .withColumn("revisit", revisit))
        written.append(_write(map_arrow(met, decided, "record binary"), f"{folder}/shared"))
    return written


def _records(batch: pa.RecordBatch, firsts: list, revisits: list) -> pa.RecordBatch:
    rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload"), firsts, revisits)
    out = [record(page_id, url, payload.as_py(), first, revisit) for page_id, url, payload, first, revisit in rows]
    return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _write(records: DataFrame, folder: str) -> str:
    """The text writer puts the closing line ends after every record and nothing else."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).text(folder)
    return folder


# ---- reading --------------------------------------------------------------

_HEADER = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)")
_LENGTH = re.compile(rb"[0-9]{1,18}")


def parse(segment: bytes) -> dict | None:
    """The fields of a record from what follows its magic, with ``size`` (bytes up to
    the successor's magic); None if that is no record's header."""
    at = segment.find(_END)
    if at < 0:
        return None
    fields = {k.lower(): v for k, v in _HEADER.findall(segment[:at])}
    if not _LENGTH.fullmatch(length := fields.get(b"content-length", b"")):
        return None
    fields[b"head"] = at + len(_END)
    fields[b"size"] = fields[b"head"] + int(length) + len(_END)
    return fields


def _page(value: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", value)
    return int(found[1]) if found else None


def content(fields: dict, segment: bytes) -> tuple:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload, url) of a whole record.
    A revisit's figures are those its headers give of the payload it refers to."""
    block = segment[fields[b"head"]:fields[b"size"] - len(_END)]
    http, _, payload = block.partition(_END)
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    url = fields.get(b"warc-target-uri")
    own = (_page(fields.get(b"warc-record-id", b"")), kind, _page(fields.get(b"warc-refers-to", b"")))
    said = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})", http)
    if kind == "revisit":
        n, digest = int(said[1]) if said else None, fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    else:
        n, digest = len(payload), payload_digest(payload)
    return (*own, n, digest, payload if kind != "revisit" else None, url.decode("utf-8", "replace") if url is not None else None)


_FIELDS = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "url"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
_RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, url string"


def _segments(batches) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, position in the split, bytes) of a task's rows, which come split by
    split in the file's order. A position counts the magic after every segment."""
    here, pos = None, 0
    for batch in batches:
        files, splits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for file, split, value in zip(files, splits, batch.column(2)):
            if (file, split) != here:
                here, pos = (file, split), 0
            segment = value.as_py()
            yield file, split, pos, segment
            pos += len(segment) + len(_MAGIC)


_CANDIDATE = "file string, split long, pos long, size long, next long, leaves long, whole boolean, "


def _chased(rows: list[tuple], is_first: bool) -> list[tuple]:
    """Rows (pos, size, next, ...) of one split with where the chain of each leaves the split
    (null: at a place where no segment begins)."""
    end = rows[-1][0] + rows[-1][1] + len(_MAGIC)
    leaves: dict[int, int | None] = {}
    for i in range(len(rows) - 1, -1, -1):
        pos, after = rows[i][0], rows[i][2]
        if is_first and i == 0:  # what stands before a file's first magic is no record
            continue
        leaves[pos] = after if after is None or after >= end else leaves.get(after)
    return [(r[0], r[1], r[2], leaves.get(r[0]), *r[3:]) for r in rows]


def candidates(lines: DataFrame, payloads: bool) -> DataFrame:
    """One row per segment of ``lines`` (file, split, value)."""

    def run(batches):
        here, rows = None, []
        for file, split, pos, segment in _segments(batches):
            if (file, split) != here:
                yield from flushed(here, rows)
                here, rows = (file, split), []
            fields = parse(segment)
            whole = fields is not None and fields[b"size"] == len(segment)
            own = content(fields, segment) if whole else (None,) * len(_FIELDS)
            if not payloads:
                own = (*own[:5], None, own[6])
            rows.append((pos, len(segment), None if fields is None else pos + fields[b"size"] + len(_MAGIC), whole, *own))
        yield from flushed(here, rows)

    def flushed(here, rows):
        if rows:
            done = _chased(rows, here[1] == 0)
            columns = list(zip(*done))
            types = [pa.int64()] * 4 + [pa.bool_()] + _TYPES
            yield pa.RecordBatch.from_arrays(
                [pa.array([here[0]] * len(done), pa.string()), pa.array([here[1]] * len(done), pa.int64()),
                 *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["file", "split", "pos", "size", "next", "leaves", "whole", *_FIELDS])

    return map_arrow(lines, run, _CANDIDATE + _RECORD)


def _lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    read = spark.read.option("lineSep", MAGIC).text(folders)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.col("value").cast("binary").alias("value"))


def _reached(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, split, pos) of the segment at which the chain from the file's start enters
    each split it enters. Pointer jumping: ``jump`` leads over 1, 2, 4, ... splits."""
    most = splits.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    at = rows.join(splits.select("file", "split", "base"), ["file", "split"])
    jump = at.where("leaves is not null").select("file", (F.col("base") + F.col("pos")).alias("at"), (F.col("base") + F.col("leaves")).alias("to"))
    starts = rows.where("split = 0 and pos = 0 and size = 0").select(F.col("file").alias("file"), F.lit(len(_MAGIC)).cast("long").alias("at"))
    if most > 1:
        jump, reached = cut(jump), cut(starts)
        for _ in range((most - 1).bit_length()):
            reached = cut(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
            far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
            jump = cut(jump.join(far, ["file", "to"]).select("file", "at", F.col("further").alias("to")))
        starts = reached
    placed = at.select("file", "split", "pos", (F.col("base") + F.col("pos")).alias("at"))
    return placed.join(starts, ["file", "at"], "left_semi").select("file", "split", "pos")


def read_archives(spark: SparkSession, folders: list[str], payloads: bool = True) -> DataFrame:
    """The records of archives: file, offset (of the record's magic), page_id, record_type, refers_to,
    payload_bytes, payload_digest (both of the full payload), payload (null of a revisit and
    with ``payloads=False``), url.

    Only records that the chain from the file's start reaches; a file that does not
    begin with a record gives none, a record that is cut off or whose length leads to no
    record or file end is left out, and so is what comes after it.
    """
    lines = _lines(spark, folders)
    rows = cut(candidates(lines, payloads))
    ends = rows.groupBy("file", "split").agg(F.max(F.col("pos") + F.col("size") + len(_MAGIC)).alias("length"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = cut(ends.select("file", "split", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("base")))
    entries = _reached(rows, splits).select("file", "split", F.col("pos").alias("entry"))

    def walked(table: pa.Table) -> pa.Table:
        """One split's segments with the position of the record that each lies in."""
        table = table.sort_by("pos")
        pos, after = table["pos"].to_pylist(), table["next"].to_pylist()
        at, on = table["entry"][0].as_py(), {}
        place = {p: i for i, p in enumerate(pos)}
        while at is not None and at in place:
            on[at] = True
            at = after[place[at]]
        owner, current = [], None
        for p in pos:
            current = p if p in on else current
            owner.append(current)
        return table.drop_columns(["entry"]).append_column("owner", pa.array(owner, pa.int64()))

    light = rows.drop("payload")
    marked = cut(light.join(entries, ["file", "split"], "left").groupBy("file", "split")
                 .applyInArrow(walked, light.schema.add("owner", "long")))
    own = marked.where("owner = pos")
    if payloads:  # the payloads stay where they were written until their records are known
        own = own.join(rows.select("file", "split", "pos", "payload"), ["file", "split", "pos"])
    else:
        own = own.withColumn("payload", F.lit(None).cast("binary"))
    based = own.join(splits.select("file", "split", "base"), ["file", "split"])
    result = ["file", (F.col("base") + F.col("pos") - len(_MAGIC)).alias("offset"), *_FIELDS]
    done = based.where("whole").select(*result)
    broken = based.where("not whole and next is not null").select("file", "split", "pos", "base", "next")
    if broken.isEmpty():
        return done
    return done.unionByName(_put_together(lines, marked, splits, broken, payloads))


def _put_together(lines: DataFrame, marked: DataFrame, splits: DataFrame, broken: DataFrame, payloads: bool) -> DataFrame:
    """Records that hold the magic, from their segments: of their own split and of the
    splits after it up to the next record."""
    last = marked.where("owner = pos").groupBy("file", "split").agg(F.max("pos").alias("last"))
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.join(last, ["file", "split"], "left")
    carried = known.select("file", "split", "base", F.last(F.col("base") + F.col("last"), True).over(over).alias("open"))
    whose = (marked.join(carried, ["file", "split"])
             .select("file", "split", "pos", (F.col("base") + F.col("pos")).alias("at"),
                     F.coalesce(F.col("base") + F.col("owner"), F.col("open")).alias("record_at")))
    wanted = broken.select("file", (F.col("base") + F.col("pos")).alias("record_at"), (F.col("base") + F.col("next")).alias("record_end"))
    pieces = cut(whose.join(wanted, ["file", "record_at"]).where("at < record_end").select("file", "split", "pos", "at", "record_at"))

    def numbered(batches):
        out: list[tuple] = []
        held = 0
        for row in _segments(batches):
            out.append(row)
            held += len(row[3])
            if held > 16 << 20:
                yield whole(out)
                out, held = [], 0
        if out:
            yield whole(out)

    def whole(out):
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())],
                                          names=["file", "split", "pos", "value"])

    values = map_arrow(lines, numbered, "file string, split long, pos long, value binary")
    met = values.join(small_or_shuffled(pieces, 200_000), ["file", "split", "pos"]).select("file", "record_at", "at", "value")

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        segment = _MAGIC.join(table["value"].to_pylist())
        fields = parse(segment)
        ok = fields is not None and fields[b"size"] == len(segment)
        own = content(fields, segment) if ok else None
        columns = [pa.array([] if own is None else [v], t) for v, t in zip(own or _FIELDS, _TYPES)]
        head = [table["file"].combine_chunks().slice(0, 1 if ok else 0),
                pa.array([table["record_at"][0].as_py() - len(_MAGIC)] if ok else [], pa.int64())]
        return pa.Table.from_arrays([*head, *columns], names=["file", "offset", *_FIELDS])

    done = met.groupBy("file", "record_at").applyInArrow(joined, "file string, offset long, " + _RECORD)
    return done if payloads else done.withColumn("payload", F.lit(None).cast("binary"))
