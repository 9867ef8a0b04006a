"""Alignment of two tokenizers by inverted pair bitmaps.

A text's tokens under A (byte-level BPE) and under B (sentence pieces) tile the same bytes.
Every pair of tokens whose byte ranges overlap is a link. How good a link is, the corpus says: an
id pair's count is the number of documents that hold it linked.

* *Postings.* Documents are numbered within blocks (at most 65,536 of them and
  some ``block_postings`` postings); a task turns each of its blocks into an inverted index:
  per id pair, a compressed bitmap of the documents that hold it (plane 0, the OR of its documents'
  bits: a sorted list of 16-bit numbers, or 8 KB of bits from 4,096 documents on), and
  multiplicity planes (plane k: bit k - 1 of how many links the document has of the pair
  beyond the first).
* *Counts.* Bitmaps of different blocks hold different documents, so their OR is their
  union and its population count is the sum of theirs: a pair's count is a sum of
  partial aggregates, and no task ever holds all of a frequent pair's bitmaps. The planes give
  the number of links, weighted by 2^(k-1).
* *Scores.* Every posting meets its pair's count in a join (one row per pair, block and plane:
  two plain shuffles) and goes back to its block, whose task adds count and
  best-ness up over the set bits for every document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import cut, map_arrow, text_or_empty
from tradelens.llm.tokens import Vocabulary, byte_level_tokens, encoder, pieces

BLOCK_DOCS = 1 << 16
BITS_FROM = 4096  # documents from which bits are shorter than a list
BITS_BYTES = BLOCK_DOCS // 8


# ---- one text -------------------------------------------------------------


class Aligner:
    """Tokens, groups and links of single texts."""

    def __init__(self, a: Vocabulary, b_path: str):
        self.encoder = encoder(a, special_as_text=True)
        self.a_bytes = byte_level_tokens(a.path)
        self.processor, self.b_bytes = pieces(b_path)
        self.a_length = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.shift = len(self.b_bytes).bit_length()
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.a_names, self.a_last = names(len(self.a_bytes), ","), names(len(self.a_bytes), "|")
        self.b_names, self.b_last = names(len(self.b_bytes), ","), names(len(self.b_bytes), ";")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids under A and B; None if the tokens' bytes are not the text's (or it is empty)."""
        if not text:
            return None
        whole = " " + text
        a, b = self.encoder.ids(whole), self.processor.encode(text)
        data = whole.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, str, np.ndarray]:
        """Number of groups and links, the groups as text, and the links' pair codes."""
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = np.concatenate([a_ends, b_ends])
        ends.sort(kind="stable")
        again = ends[1:] == ends[:-1]  # token ends of both: a group ends there
        common, ends = ends[1:][again], ends[np.concatenate([[True], ~again])]
        # no token has no bytes, so between two ends lies one token of each side, and each
        # overlapping pair of tokens has one such stretch
        codes = (a[np.searchsorted(a_ends, ends)] << self.shift) | b[np.searchsorted(b_ends, ends)]
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        names = np.concatenate([np.where(np.isin(a_ends, common, assume_unique=True), self.a_last[a], self.a_names[a]),
                                np.where(np.isin(b_ends, common, assume_unique=True), self.b_last[b], self.b_names[b])])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        return len(common), len(ends), "".join(names[order].tolist())[:-1], codes


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a: Vocabulary, b_path: str) -> Aligner:
    if (a, b_path) not in _ALIGNERS:
        _ALIGNERS[a, b_path] = Aligner(a, b_path)
    return _ALIGNERS[a, b_path]


# ---- bitmaps --------------------------------------------------------------


def bitmaps(owner: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """From sorted (owner, document) rows: the first row and number of documents of each
    owner, and the compressed bitmaps."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    n = np.diff(np.append(first, len(owner)))
    dense = n >= BITS_FROM
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(np.where(dense, BITS_BYTES, 2 * n), out=offsets[1:])
    data = np.zeros(offsets[-1] // 2, dtype="<u2")
    listed = np.repeat(~dense, n)
    at = np.repeat(offsets[:-1] // 2 - first, n) + np.arange(len(owner))
    data[at[listed]] = docs[listed]
    for k in np.flatnonzero(dense):
        bits = np.zeros(BLOCK_DOCS, dtype=np.uint8)
        bits[docs[first[k]:first[k] + n[k]]] = 1
        data[offsets[k] // 2:offsets[k + 1] // 2] = np.packbits(bits).view("<u2")
    return first, n, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def members(found: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(which bitmap, document) of every set bit."""
    rows, docs = [], []
    for value in found:
        data = value.as_buffer()
        if len(data) == BITS_BYTES:
            own = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
        else:
            own = np.frombuffer(data, "<u2")
        docs.append(own.astype(np.int64))
        rows.append(len(own))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), rows), np.concatenate(docs)


# ---- postings -------------------------------------------------------------

_DOC = [("nth", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_POSTING = [("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]
_SCHEMA = pa.schema([("seq", pa.int64()), *_DOC, *_POSTING])
_SPARK = ("seq long, nth int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "a int, b int, plane int, n long, bits binary")


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _block(seq: int, docs: list[tuple], codes: list[np.ndarray], counts: list[np.ndarray], shift: int):
    """The rows of one block: its documents, and its postings by pair and plane."""
    done = {name: pa.array(c, t) for (name, t), c in zip(_DOC, zip(*docs))}
    yield _rows({"seq": pa.array(np.full(len(docs), seq)), **done})
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    if not len(code):
        return
    nth = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    order = np.argsort((code << 16) | nth, kind="stable")
    code, nth, beyond = code[order], nth[order], np.concatenate(counts)[order] - 1
    for plane in range(int(beyond.max()).bit_length() + 1):
        own = slice(None) if plane == 0 else (beyond >> (plane - 1)) & 1 == 1
        pair = code[own]
        if not len(pair):
            continue
        first, n, bits = bitmaps(pair, nth[own])
        pair = pair[first]
        whole = _rows({"seq": pa.array(np.full(len(pair), seq)), "a": pa.array((pair >> shift).astype(np.int32)),
                       "b": pa.array((pair & ((1 << shift) - 1)).astype(np.int32)),
                       "plane": pa.array(np.full(len(pair), plane, np.int32)), "n": pa.array(n.astype(np.int64)), "bits": bits})
        for at in range(0, len(pair), 10_000):
            yield whole.slice(at, 10_000)


def postings(docs: DataFrame, a: Vocabulary, b_path: str, block_postings: int = 2_000_000) -> DataFrame:
    """Document rows (plane null) and postings (plane not null) of every block, with ``block``."""

    def run(batches):
        own = aligner(a, b_path)
        seq, rows, codes, counts, held = 0, [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = own.tokens(text.as_py())
                if found is None:
                    rows.append((len(rows), doc_id.as_py(), 0, 0, 0, 0, ""))
                    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    groups, links, text_groups, code = own.align(*found)
                    rows.append((len(rows), doc_id.as_py(), len(found[0]), len(found[1]), groups, links,
                                 hashlib.sha256(text_groups.encode()).hexdigest()))
                    code, n = np.unique(code, return_counts=True)
                codes.append(code)
                counts.append(n)
                held += len(code)
                if held >= block_postings or len(rows) == BLOCK_DOCS:
                    yield from _block(seq, rows, codes, counts, own.shift)
                    seq, rows, codes, counts, held = seq + 1, [], [], [], 0
        if rows:
            yield from _block(seq, rows, codes, counts, own.shift)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(read, run, _SPARK).withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("seq")).drop("seq")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n_docs (documents that hold the pair linked), n_links (links of the pair), best
    (no pair of the same a has a higher n_docs). From :func:`postings`."""
    own = found.where("plane is not null")
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    counts = own.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"),
                                       F.sum(F.col("n") * weight).alias("n_links"))
    of_a = Window.partitionBy("a")  # at most as many rows as B has pieces
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def align(docs: DataFrame, a: Vocabulary, b_path: str, block_postings: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the pairs (:func:`pair_counts`).

    A null or empty text, or one whose tokens' joined bytes differ from space + text under A or B,
    has no tokens: zeros and an empty groups_sha256. Rows that share a doc_id, or have none, are
    documents of their own. Strings of special tokens are ordinary text. An empty table gives no rows.
    """
    found = cut(postings(docs, a, b_path, block_postings))
    pairs = cut(pair_counts(found))
    scored = (found.where("plane is not null").select("block", "a", "b", "plane", "bits")
              .join(pairs.select("a", "b", "n_docs", "best"), ["a", "b"])
              .select("block", "plane", "bits", "n_docs", "best"))
    rows = found.where("plane is null").select("block", "nth", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = rows.unionByName(scored, allowMissingColumns=True)

    def returned(table: pa.Table) -> pa.Table:
        is_doc = table["plane"].is_null()
        own = table.filter(is_doc).sort_by("nth")
        back = table.filter(table["plane"].is_valid())
        where, nth = members(back["bits"])
        plane = back["plane"].to_numpy().astype(np.int64)
        weight = np.left_shift(np.int64(1), np.maximum(plane - 1, 0))
        best, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows, np.int64)
        np.add.at(total, nth, (weight * back["n_docs"].to_numpy())[where])
        np.add.at(best, nth, (weight * back["best"].to_numpy(zero_copy_only=False).astype(np.int64))[where])
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table({**{n: own[n] for n in names}, "n_best": pa.array(best), "count_sum": pa.array(total),
                         "groups_sha256": own["groups_sha256"]})

    done = both.groupBy("block").applyInArrow(returned, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                                        "n_best long, count_sum long, groups_sha256 string")
    return done, pairs
