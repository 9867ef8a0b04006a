"""Exact deduplication by Grace hashing.

Three steps, none of which gathers a group of copies anywhere:

1. *Combine.* Each scan task folds its own rows: equal texts become one record
   (text once, number of rows, row with the largest doc_id). A text that fills a
   third of the table leaves a task as a few records.
2. *Grace hash.* The records are shuffled by the SHA-256 of their text. Each task
   folds its bucket with an open-addressing table that compares complete texts. A
   bucket whose distinct texts exceed ``bucket_bytes`` is partitioned into sixteen
   spill files by the next digit of the digest, each of them again, until it fits.
   The spill files are anonymous files of the task (they vanish with it, a task
   that is run again starts over, and no other task ever reads them).
3. *Report.* Either the surviving records are the result (:func:`keep_rows`), or
   every row is joined to its class on the digest (:func:`duplicate_classes`), a
   join of two plain shuffles that adaptive execution splits for a hot digest.

Two different texts with one SHA-256 would make step 3 ambiguous; the table
compares texts, so it would notice, and the job fails instead of merging them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import map_arrow, text_or_empty

WAYS = "0123456789abcdef"  # one spill file per hex digit


class DigestCollision(RuntimeError):
    pass


def fold(rows: pa.Table) -> pa.Table:
    """One row per distinct text: the row with the largest id (the first of
    equals; a null id counts as smallest), with the sum of ``n``. Columns key, id,
    n, text and any others. Open addressing with linear probing."""
    keys, texts = rows["key"].to_pylist(), rows["text"].to_pylist()
    ids, counts = rows["id"].to_pylist(), rows["n"].to_pylist()
    size = 1 << max(3, (2 * len(keys)).bit_length())
    slots = [-1] * size
    best: list[int] = []
    total: list[int] = []
    for i, key in enumerate(keys):
        at = int(key[-15:], 16) & (size - 1)
        while (group := slots[at]) >= 0:
            j = best[group]
            if texts[j] == texts[i]:
                total[group] += counts[i]
                if ids[i] is not None and (ids[j] is None or ids[i] > ids[j]):
                    best[group] = i
                break
            if keys[j] == key:
                raise DigestCollision(f"two texts have the digest {key}")
            at = (at + 1) & (size - 1)
        else:
            slots[at] = len(best)
            best.append(i)
            total.append(counts[i])
    kept = rows.take(pa.array(best, pa.int64()))
    return kept.set_column(kept.column_names.index("n"), "n", pa.array(total, pa.int64()))


def combined(batches: Iterator[pa.RecordBatch], window_bytes: int) -> Iterator[pa.Table]:
    """Fold as many batches at a time as ``window_bytes`` allow."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= window_bytes:
            yield fold(pa.Table.from_batches(held))
            held = []
    if held:
        yield fold(pa.Table.from_batches(held))


def grace(batches: Iterator[pa.RecordBatch], bucket_bytes: int, level: int = 0) -> Iterator[pa.Table]:
    """Fold a bucket of any size in about twice ``bucket_bytes`` of memory."""
    held: list = []
    held_bytes = 0
    batches = iter(batches)
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        held_bytes += batch.nbytes
        if held_bytes < bucket_bytes:
            continue
        table = fold(pa.concat_tables(held))
        held, held_bytes = [table], table.nbytes
        if held_bytes < bucket_bytes // 2 or table.num_rows < 2 or level >= 64:
            continue
        yield from _spilled(table, batches, bucket_bytes, level)
        return
    if held:
        yield fold(pa.concat_tables(held))


def _spilled(table: pa.Table, rest: Iterator[pa.RecordBatch], bucket_bytes: int, level: int) -> Iterator[pa.Table]:
    schema = table.schema
    files = {w: tempfile.TemporaryFile() for w in WAYS}
    sinks = {w: pa.ipc.new_stream(f, schema) for w, f in files.items()}

    def scatter(part: pa.Table) -> None:
        digits = [k[level] for k in part["key"].to_pylist()]
        for way in set(digits):
            chosen = part.filter(pa.array([d == way for d in digits]))
            sinks[way].write_table(chosen)

    scatter(table)
    del table
    for batch in rest:
        scatter(pa.Table.from_batches([batch]).cast(schema))
    for way, sink in sinks.items():
        sink.close()
    for way, file in files.items():
        file.seek(0)
        yield from grace(pa.ipc.open_stream(file), bucket_bytes, level + 1)
        file.close()


def _classes(rows: DataFrame, window_bytes: int, bucket_bytes: int, carry: bool) -> DataFrame:
    """Steps 1 and 2 over ``rows`` (key, id, n, text and, to ``carry``, the whole row)."""
    names = rows.columns
    out_names = names if carry else ["key", "id", "n"]

    def combine(batches):
        for t in combined(batches, window_bytes):
            yield from t.to_batches()

    def finish(batches):
        for t in grace(batches, bucket_bytes):
            yield from t.select(out_names).to_batches()

    partial = map_arrow(rows, combine, rows.schema)
    out = rows.schema if carry else rows.select(*out_names).schema
    return map_arrow(partial.repartition("key"), finish, out)


def _records(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"), *more).select(
        F.sha2(F.col("text").cast("binary"), 256).alias("key"), "id", F.lit(1).cast("long").alias("n"), "text",
        *(["row"] if more else []))


def duplicate_classes(docs: DataFrame, window_bytes: int = 48 << 20,
                      bucket_bytes: int = 96 << 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id`` (largest doc_id with
    the same text), ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; null counts as empty. Rows that repeat the
    staying doc_id with the same text are that document and all say kept; a null
    doc_id is kept only in a group without any id. Other columns are ignored.
    """
    records = _records(docs)
    classes = _classes(records, window_bytes, bucket_bytes, carry=False).select(
        "key", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    return records.select("key", F.col("id").alias("doc_id")).join(classes, "key").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("key").alias("text_sha256"))


def keep_rows(docs: DataFrame, window_bytes: int = 48 << 20, bucket_bytes: int = 96 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts exactly one
    row, that with the largest doc_id (of repeated rows, one). One shuffle, which
    carries every text once: the rest of a row travels beside it."""
    rest = F.struct(F.col("text").isNull().alias("no_text"),
                    *[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns if c != "text"])
    kept = _classes(_records(docs, rest.alias("row")), window_bytes, bucket_bytes, carry=True)
    text = F.when(~F.col("row.no_text"), F.col("text")).cast(docs.schema["text"].dataType)
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"row.`_{c}`").alias(c) for c in docs.columns])
