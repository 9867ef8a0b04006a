"""Removal of repeated passages, found by difference-cover anchors.

Words are runs of anything but ASCII white space. A window is ``window``
consecutive words of one document; a word goes if it lies in a window whose words
also start somewhere in a document with a smaller doc_id.

1. *Whole copies.* Of documents with the same words only the smallest doc_id
   takes part below; the others are covered from end to end.
2. *Anchors.* A difference cover D modulo v holds, for every d, two members that
   differ by d. So if windows of two documents are equal, there is a shift below v
   that brings both starts to positions that are in D modulo v. It is enough to
   hash ``window - v + 1`` words at those positions (6 of 31): equal windows always
   share one such anchor. An anchor found in two documents is shared.
3. *Extension.* Every window that contains a shared anchor is hashed in full (96
   bits) and meets the windows with the same hash: the smallest doc_id among them
   decides. No pairs are made: minima are partial aggregates, and joins back have
   two plainly shuffled sides, so a passage in a third of all documents is split.

What is known of a document's positions travels as spans (a run of neighbouring
windows is one span). Ids of whole copies and spans are broadcast to the text
scan if a count finds them few, else those joins shuffle the texts.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, limited, map_arrow, small_or_shuffled, text_or_empty
from tradelens.llm.rolling import BASES, Windows, covered, item_hashes, spans

# Perfect difference sets (every non-zero difference comes once).
PERFECT = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def difference_cover(period: int) -> tuple[int, ...]:
    """Positions modulo ``period`` such that every difference occurs among them."""
    if period in PERFECT:
        return PERFECT[period]
    step = int(np.ceil(np.sqrt(period)))
    return tuple(sorted({*range(min(step, period)), *range(0, period, step)}))


def period_for(window: int) -> int:
    """The largest period with a perfect cover that leaves two fifths of a window to hash."""
    return max((p for p in PERFECT if 5 * (window - p + 1) >= 2 * window), default=max(1, window // 2))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, tk, text. tk tells rows apart that share a doc_id: 0 if none do, else a
    hash of the text (rows that share both are the same)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.select("doc_id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tk"), "text")


def _copies(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, tk) of rows whose words all come in a document with a smaller id."""

    def digest(batches):
        for batch in batches:
            out = []
            for text in batch.column(2):
                words = word_list(text.as_py())
                out.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if len(words) >= window else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             names=["doc_id", "tk", "digest"])

    digests = cut(map_arrow(rows, digest, "doc_id long, tk long, digest binary").where("digest is not null and doc_id is not null"))
    first = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("first")))
    return cut(digests.join(first, "digest").where("doc_id > first").select("doc_id", "tk").distinct())


def _anchors(rows: DataFrame, window: int, period: int) -> DataFrame:
    width, cover = window - period + 1, np.zeros(period, dtype=bool)
    cover[list(difference_cover(period))] = True

    def run(batches):
        hasher = Windows(BASES[0])
        for batch in batches:
            parts = []
            for i, text in enumerate(batch.column(2)):
                words = word_list(text.as_py())
                if len(words) >= window:
                    found = hasher.hashes(item_hashes(words), width)
                    at = np.flatnonzero(cover[np.arange(len(found)) % period])
                    parts.append((i, at, found[at].view(np.int64)))
            yield from position_batches(batch, parts, ["hash"])

    return map_arrow(rows, run, "hash long, doc_id long, tk long, pos int")


def position_batches(batch: pa.RecordBatch, parts: list[tuple], names: list[str]) -> list[pa.RecordBatch]:
    """Flat rows (hashes..., doc_id, tk, pos) from parts (row of ``batch``, positions,
    hashes...); ``batch`` begins with doc_id and tk."""
    if not parts:
        return []
    row = pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]))
    columns = [pa.array(np.concatenate([p[2 + k] for p in parts])) for k in range(len(names))]
    pos = pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32))
    whole = pa.RecordBatch.from_arrays([*columns, batch.column(0).take(row), batch.column(1).take(row), pos],
                                       names=[*names, "doc_id", "tk", "pos"])
    return [whole.slice(at, 50_000) for at in range(0, whole.num_rows, 50_000)]


SPANS = "array<struct<start:int,length:int>>"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _spans(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Per document, the spans that its positions and ``before`` / ``after`` items
    around each make up. A document's own length bounds its list."""

    def run(batches):
        for batch in batches:
            found = []
            for at in batch.column(2):
                positions = at.values.to_numpy(zero_copy_only=False).astype(np.int64)
                mask = covered(positions - before, before + 1 + after, int(positions.max()) + 1 + after)
                found.append([{"start": a, "length": n} for a, n in spans(mask)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _SPAN_LIST)],
                                             names=["doc_id", "tk", "spans"])

    listed = rows.groupBy("doc_id", "tk").agg(F.collect_set("pos").alias("at"))
    return cut(map_arrow(listed, run, f"doc_id long, tk long, spans {SPANS}"))


def _inside(found, n: int) -> np.ndarray:
    """Which of n items the spans of an Arrow value hold."""
    mask = np.zeros(n, dtype=bool)
    for span in found.as_py():
        mask[span["start"]:span["start"] + span["length"]] = True
    return mask


def repeated_windows(docs: DataFrame, window: int = 50, broadcast_limit: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, tk, text), and per row (doc_id, tk) with something to
    remove the ``spans`` of its words in windows that come in a smaller document
    (null: all words)."""
    period = period_for(window)
    rows = identified(docs)
    copies = _copies(rows, window)
    keys = ["doc_id", "tk"]
    single = rows.where("doc_id is not null").join(small_or_shuffled(copies, broadcast_limit // 2), keys, "left_anti")

    anchors = _anchors(single, window, period)
    shared = cut(anchors.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                 .where("lo < hi").select("hash"))
    # an anchor at p lies in the windows that start from p - period + 1 to p
    anchored = _spans(anchors.join(shared, "hash"), period - 1, 0)

    def extend(batches):
        one, two = Windows(BASES[0]), Windows(BASES[1])
        for batch in batches:
            parts = []
            for i, (text, found) in enumerate(zip(batch.column(2), batch.column(3))):
                items = item_hashes(word_list(text.as_py()))
                starts = np.flatnonzero(_inside(found, len(items) - window + 1))
                more = (two.hashes(items, window)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                parts.append((i, starts, one.hashes(items, window)[starts].view(np.int64), more))
            yield from position_batches(batch, parts, ["h1", "h2"])

    near = rows.join(limited(anchored, F.size("spans"), broadcast_limit), keys).select(*keys, "text", "spans")
    windows = map_arrow(near, extend, "h1 long, h2 int, doc_id long, tk long, pos int")
    first = cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                .where("lo < hi").select("h1", "h2", "lo"))
    again = _spans(windows.join(first, ["h1", "h2"]).where("doc_id > lo"), 0, window - 1)
    return rows, again.unionByName(copies.withColumn("spans", F.lit(None).cast(SPANS)))


def remove_repeats(docs: DataFrame, window: int = 50, broadcast_limit: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id and text; other columns are
    ignored): doc_id, ``n_words``, ``removed`` (array of word spans start, length)
    and ``kept_text``, the words that stay joined by one space.

    Null or empty texts have no words. A text with fewer words than a window is
    never touched. A row without doc_id comes before or after nothing: it stays
    whole and removes nothing elsewhere. Rows that share a doc_id do not remove
    each other's words. An empty table gives no rows.
    """
    rows, again = repeated_windows(docs, window, broadcast_limit)
    renamed = again.select(F.col("doc_id").alias("r_id"), F.col("tk").alias("r_tk"), "spans", F.lit(True).alias("found"))
    joined = rows.join(limited(renamed, F.coalesce(F.size("spans"), F.lit(1)), broadcast_limit), (F.col("doc_id") == F.col("r_id")) & (F.col("tk") == F.col("r_tk")), "left")

    def keep(batches):
        for batch in batches:
            out = []
            for text, own, found in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = word_list(text.as_py())
                n, gone = len(words), []
                if found.as_py():
                    mask = _inside(own, n) if own.is_valid else np.ones(n, bool)
                    gone = spans(mask)
                    words = list(itertools.compress(words, (~mask).tolist()))
                out.append((n, [{"start": a, "length": b} for a, b in gone], b" ".join(words).decode("utf-8", "surrogatepass")))
            kept = [pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    pa.array([o[2] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept], names=["doc_id", "n_words", "removed", "kept_text"])

    return map_arrow(joined.select("doc_id", "text", "spans", "found"), keep,
                     "doc_id long, n_words long, removed array<struct<start:long,length:long>>, kept_text string")
