"""Removal of repeated runs of lines, found by winnowing.

Lines are what line feeds separate, compared as written; a line of white space only is
blank. "Already come" means in a document with a smaller doc_id, or further up in the same
document without overlapping. A line goes if

* it lies in a window of ``run`` consecutive lines that has already come (blank lines
  included), or
* it has at least ``long_line`` characters, is not blank, and has already come as a line, or
* it is not blank and equals the line directly above it.

The first occurrence of a run or of a long line stays. The runs are found by winnowing; the long lines by an exact
pass beside it.

1. *Winnowing.* Every ``gram`` consecutive lines have a hash, and of every
   ``run - gram + 1`` consecutive hashes the smallest (the rightmost of equals) is
   selected. Equal runs select equal hashes, so two occurrences of a run always
   share a selected fingerprint, while only some of all hashes are kept.
2. *Join positions.* Fingerprints that occur more than once are joined back to
   where they were selected.
3. *Extension.* Around such a position every window that contains it is hashed in
   full (two 64-bit hashes) in both directions, and meets the windows with the same
   hashes; the earliest (doc_id, position) among them stays, later ones go, and
   overlapping windows grow together to the whole repeated run.

4. *Long lines.* Every long line is a window of its own, hashed in full; the same minima
   decide. Equal lines in a row need no search.

No pairs are made: minima are partial aggregates and the joins back have two
plainly shuffled sides, which adaptive execution splits for a line found everywhere.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, limited, map_arrow
from tradelens.llm.rolling import BASES, Windows, covered, item_hashes, spans
from tradelens.llm.substring_dedup import identified, position_batches


def line_list(text: str | None) -> list[bytes]:
    """No lines for a missing or empty text."""
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the minima of all windows of ``width`` hashes, rightmost of equals."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(axis=1))


def _fingerprints(rows: DataFrame, run: int, gram: int) -> DataFrame:
    def select(batches):
        hasher = Windows(BASES[0])
        for batch in batches:
            parts = []
            for i, text in enumerate(batch.column(2)):
                hashes = hasher.hashes(item_hashes(line_list(text.as_py())), gram)
                at = winnowed(hashes, run - gram + 1)
                parts.append((i, at, hashes[at].view(np.int64)))
            yield from position_batches(batch, parts, ["hash"])

    return map_arrow(rows, select, "hash long, doc_id long, tk long, pos int")


def is_blank(line: bytes) -> bool:
    return not line.strip(b" \t\n\v\f\r")


def _long_lines(rows: DataFrame, least: int) -> DataFrame:
    def run(batches):
        one, two = Windows(BASES[0]), Windows(BASES[1])
        for batch in batches:
            parts = []
            for i, text in enumerate(batch.column(2)):
                lines = line_list(text.as_py())
                at = np.array([k for k, line in enumerate(lines) if len(line) >= least and not is_blank(line)
                               and len(line.decode("utf-8", "surrogatepass")) >= least], dtype=np.int64)
                items = item_hashes([lines[k] for k in at])
                parts.append((i, at, one.hashes(items, 1).view(np.int64), two.hashes(items, 1).view(np.int64)))
            yield from position_batches(batch, parts, ["h1", "h2"])

    return map_arrow(rows, run, "h1 long, h2 long, doc_id long, tk long, pos int")


def repeated_above(lines: list[bytes]) -> np.ndarray:
    """Which lines are not blank and equal the line directly above."""
    return np.array([k > 0 and line == lines[k - 1] and not is_blank(line) for k, line in enumerate(lines)], dtype=bool)


def remove_repeated_lines(docs: DataFrame, run: int = 3, gram: int = 2, long_line: int | None = None,
                          broadcast_limit: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id and text; other columns are
    ignored): doc_id, ``n_lines``, ``removed`` (array of line spans start, length)
    and ``kept_text``, the lines that stay joined by line feeds.

    Without ``long_line`` only runs go. A null or empty text has no lines. A row without
    doc_id comes before or after nothing: only its lines that equal the line above go, and it
    removes nothing elsewhere. Rows that share doc_id and text are one document; other rows
    that share a doc_id are ordered by a hash of their text. An empty table
    gives no rows.
    """
    if not 1 <= gram <= run:
        raise ValueError("gram must be from 1 to run")
    rows = identified(docs)
    keys = ["doc_id", "tk"]
    known = rows.where("doc_id is not null").dropDuplicates(keys) if _has_repeats(rows) else rows.where("doc_id is not null")
    marks = _fingerprints(known, run, gram)
    shared = cut(marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    anchored = cut(marks.join(shared, "hash").groupBy(*keys).agg(F.collect_set("pos").alias("at")))

    def extend(batches):
        one, two = Windows(BASES[0]), Windows(BASES[1])
        reach = run - gram + 1
        for batch in batches:
            parts = []
            for i, (text, at) in enumerate(zip(batch.column(2), batch.column(3))):
                items = item_hashes(line_list(text.as_py()))
                found = at.values.to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.flatnonzero(covered(found - reach + 1, reach, len(items))[:len(items) - run + 1])
                parts.append((i, starts, one.hashes(items, run)[starts].view(np.int64),
                              two.hashes(items, run)[starts].view(np.int64)))
            yield from position_batches(batch, parts, ["h1", "h2"])

    near = known.join(limited(anchored, F.size("at"), broadcast_limit), keys).select(*keys, "text", "at")
    windows = map_arrow(near, extend, "h1 long, h2 long, doc_id long, tk long, pos int").withColumn("width", F.lit(run))
    if long_line is not None:
        windows = windows.unionByName(_long_lines(known, long_line).withColumn("width", F.lit(1)))
    first = cut(windows.groupBy("width", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "pos")).alias("first"))
                .where("n > 1").select("width", "h1", "h2", "first"))
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
    later = windows.join(first, ["width", "h1", "h2"]).where(~same | (F.col("pos") >= F.col("first.pos") + F.col("width")))
    found = cut(later.groupBy(*keys).agg(F.collect_set(F.when(F.col("width") == run, F.col("pos"))).alias("at"),
                                         F.collect_set(F.when(F.col("width") != run, F.col("pos"))).alias("lines")))
    again = found.select(F.col("doc_id").alias("r_id"), F.col("tk").alias("r_tk"), "at", "lines")
    joined = rows.join(limited(again, F.size("at") + F.size("lines"), broadcast_limit),
                       (F.col("doc_id") == F.col("r_id")) & (F.col("tk") == F.col("r_tk")), "left")

    def keep(batches):
        for batch in batches:
            out = []
            for text, at, single in zip(batch.column(1), batch.column(2), batch.column(3)):
                lines = line_list(text.as_py())
                n, gone = len(lines), []
                mask = repeated_above(lines) if long_line is not None else np.zeros(n, dtype=bool)
                if at.is_valid:
                    mask |= covered(at.values.to_numpy(zero_copy_only=False).astype(np.int64), run, n)
                    mask[single.values.to_numpy(zero_copy_only=False).astype(np.int64)] = True
                if mask.any():
                    gone, lines = spans(mask), list(itertools.compress(lines, (~mask).tolist()))
                out.append((n, [{"start": a, "length": b} for a, b in gone], b"\n".join(lines).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                 pa.array([o[2] for o in out], pa.string())], names=["doc_id", "n_lines", "removed", "kept_text"])

    return map_arrow(joined.select("doc_id", "text", "at", "lines"), keep,
                     "doc_id long, n_lines long, removed array<struct<start:long,length:long>>, kept_text string")


def _has_repeats(rows: DataFrame) -> bool:
    """identified() hashes texts only where doc_ids repeat."""
    return not rows.groupBy("doc_id", "tk").count().where("count > 1").isEmpty()
