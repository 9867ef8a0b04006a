"""Packing documents into fixed-length token sequences.

A document is its token ids and one end id. Every document is cut into whole
pieces of ``size`` tokens and one shorter rest. The rests are packed by
shortest-pack-first over the histogram of their lengths: lengths are placed
longest first, each into the packs that have most room left, and what is updated
is the number of packs of every pattern, not single packs. The histogram has at
most ``size`` entries whatever the corpus, and so has the plan on the driver.

Pieces meet the plan by rank: the k-th piece of a length takes the k-th place
the plan has for it. Ranks are made without gathering a length in one task: rows
are numbered inside (length, chunk), where a chunk is dealt by a piece's place in the
written table, and shifted by the counts of the chunks before.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import cut, map_arrow, text_or_empty
from tradelens.llm.tokens import Vocabulary, encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: Vocabulary, size: int, end_id: int = 0) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids, doc_id = encode(text.as_py()) + end, doc_id.as_py()
                n = len(ids) // 4
                for start in range(0, n, size):
                    own = ids[4 * start:4 * (start + size)]
                    rows.append((doc_id, start, len(own) // 4, zlib.crc32(own), n))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")),
                     run, PIECE)


# ---- the plan -------------------------------------------------------------


@dataclass(frozen=True)
class Place:
    """Ranks [first, first + count * repeat) of a length go to sequences
    base + (rank - first) // repeat at offset + ((rank - first) % repeat) * length."""

    length: int
    first: int
    count: int
    repeat: int
    base: int
    offset: int


def packing_patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first over a histogram {length: pieces}: (number of packs,
    [(length, how often), ...]) per pattern."""
    by_room: dict[int, list] = defaultdict(list)  # room left -> [[packs, pattern], ...]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs and r >= length), default=None)
            if room is None:
                break
            packs, pattern = by_room[room].pop()
            used = min(packs, left)
            left -= used
            if used < packs:
                by_room[room].append([packs - used, pattern])
            grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length \
                else [*pattern, (length, 1)]
            by_room[room - length].append([used, grown])
        per = size // length
        whole, rest = divmod(left, per)
        if whole:
            by_room[size - per * length].append([whole, [(length, per)]])
        if rest:
            by_room[size - rest * length].append([1, [(length, rest)]])
    return [(packs, pattern) for r in sorted(by_room) for packs, pattern in by_room[r]]


def places(histogram: dict[int, int], size: int) -> list[Place]:
    used: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for packs, pattern in packing_patterns(histogram, size):
        offset = 0
        for length, repeat in pattern:
            out.append(Place(length, used[length], packs, repeat, base, offset))
            used[length] += packs * repeat
            offset += length * repeat
        base += packs
    return out


# ---- the operator ---------------------------------------------------------


def dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """With ``chunk`` by a row's place in its partition, so that one row repeated without
    end is spread over all of them. To be written before it is read twice."""
    return rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))


def pack(docs: DataFrame, vocabulary: Vocabulary, size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null or empty text is one token, the end id. Repeated rows and null
    doc_ids are packed like any others. An empty table gives no rows. Other
    columns are ignored. Sequence ids run from 0 without gaps.
    """
    spark = docs.sparkSession
    chunks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut_up = cut(dealt(pieces(docs, vocabulary, size, end_id), chunks))
    counts = cut_up.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(counts.select("length", "chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    histogram = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame([(p.length, p.first, p.count * p.repeat, p.repeat, p.base, p.offset)
                                  for p in places(histogram, size)],
                                 "length long, first long, n_ranks long, repeat long, base long, at long")
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (cut_up.withColumn("rank", F.row_number().over(inside) - 1)
              .join(shifts.select("length", "chunk", "shift"), ["length", "chunk"])
              .withColumn("rank", F.col("rank") + F.col("shift")))
    # The plan has at most two patterns per length of the histogram: bounded by
    # the sequence size, not by the corpus.
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= first and rank < first + n_ranks")
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(nth / F.col("repeat"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("repeat")) * F.col("length")).cast("long").alias("offset"))
