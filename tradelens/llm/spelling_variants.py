"""Spelling variants: words one edit apart, found through Bloom-guided neighbourhoods.

* *Vocabulary.* Scan tasks count their words in tables of bounded size; the partial counts
  are summed per word.
* *Neighbourhoods.* Every word generates its deletions (an insertion is the longer word's
  deletion) and its replacements by later characters of the vocabulary's alphabet (the
  earlier ones are the other word's). Their hashes come from the word's polynomial hash, all
  at once in numpy, and are probed against blocked Bloom filters, one per word length,
  which are broadcast: their size is bounded by ``filter_bytes`` however many words there are
  (fuller filters let more false positives through, never fewer words).
* *Exact join.* Only what a filter holds becomes a string and is shuffled to the
  vocabulary, where the join drops the false positives.
* *Roots.* A form is at least twice as frequent as its word, so chains of forms are short;
  pointer jumping halves what is left of them with every round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm import blocked_bloom
from tradelens.llm.common import cut, map_arrow, text_or_empty

# Words are runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. All of them are single
# bytes of Latin-1, in which texts are cut up; what Latin-1 lacks becomes a question mark.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
SHARDS = 64  # longer words share the last filter
WINDOW = 1 << 20


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text in Latin-1, in portions."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + WINDOW)  # at a gap, however long the run before it is
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def edited(word: bytes, base: int, every: int) -> bytes:
    """``word`` as it stands in the document whose prefix has the CRC ``base``: where the
    checksum is divisible by ``every``, one code point is missing."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), base)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, min_length: int = 5, every: int = 97, table_words: int = 300_000) -> DataFrame:
    """(word, n) over all documents, summed from the tables of the tasks."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                base = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                own: Counter[bytes] = Counter()
                for portion in runs(text.as_py()):
                    own.update(portion)
                    if len(own) > table_words:  # of one very long text
                        yield from flushed(counts, own, base)
                        counts.clear()
                        own.clear()
                add(counts, own, base)
                if len(counts) > table_words:
                    yield from flushed(counts, {}, base)
                    counts.clear()
        yield from flushed(counts, {}, 0)

    def add(counts, own, base):
        for word, n in own.items():
            if len(word) >= min_length and len(word := edited(word, base, every)) >= min_length:
                counts[word] += n

    def flushed(counts, own, base):
        add(counts, own, base)
        words, n = list(counts), list(counts.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words[at:at + 50_000]], pa.string()),
                                              pa.array(n[at:at + 50_000], pa.int64())], names=["word", "n"])

    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(read, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- neighbourhoods -------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # an odd multiplier of a polynomial modulo 2**64 (any does)
_MASK = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out, power = [], 1
    for _ in range(n):
        out.append(power)
        power = power * _BASE & _MASK
    return np.array(out, dtype=np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread over all bits (a polynomial's low bits know little of the high ones)."""
    h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def polynomial(letters: np.ndarray) -> np.ndarray:
    """One hash per row of a table of character codes."""
    return (letters.astype(np.uint64) * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, table of character codes) of the words of each length."""
    coded = [w.encode("latin-1") for w in words]
    lengths = np.array([len(w) for w in coded])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, np.frombuffer(b"".join(coded[i] for i in rows), np.uint8).reshape(-1, n)


def shard(length: int) -> int:
    return min(length, SHARDS)


def word_keys(vocabulary: DataFrame) -> DataFrame:
    """(shard, hash) of every word."""

    def run(batches):
        for batch in batches:
            for rows, letters in by_length(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), shard(letters.shape[1]), np.int32)),
                     pa.array(mixed(polynomial(letters)).view(np.int64))], names=["shard", "hash"])

    return map_arrow(vocabulary.select("word"), run, "shard int, hash long")


def _strings(letters: np.ndarray) -> list[str]:
    return [row.tobytes().decode("latin-1") for row in letters]


def _candidates(filters: dict[int, np.ndarray], letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, edits) of words of one length whose edits the filters may hold."""
    count, n = letters.shape
    powers, whole = _powers(n + 1), polynomial(letters)
    own, shorter = filters.get(shard(n)), filters.get(shard(n - 1))
    if shorter is not None:
        terms = letters.astype(np.uint64) * powers[:n]
        before = np.concatenate([np.zeros((count, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    for at in range(n):
        if shorter is not None:
            # what follows moves one place to the front
            hashes = mixed(before[:, at] + (whole - before[:, at + 1]) * inverse)
            hit = blocked_bloom.may_hold(shorter, hashes)
            if at:  # of equal letters in a row, any deletion is the first one's
                hit &= letters[:, at] != letters[:, at - 1]
            if hit.any():
                rows = np.flatnonzero(hit)
                yield rows, _strings(np.delete(letters[rows], at, axis=1))
        if own is not None:
            for letter in alphabet.tolist():
                rows = np.flatnonzero(letters[:, at] < letter)
                step = (np.uint64(letter) - letters[rows, at].astype(np.uint64)) * powers[at]
                rows = rows[blocked_bloom.may_hold(own, mixed(whole[rows] + step))]
                if len(rows):
                    changed = letters[rows].copy()
                    changed[:, at] = letter
                    yield rows, _strings(changed)


def near_pairs(vocabulary: DataFrame, filter_bytes: int = 64 << 20) -> DataFrame:
    """(word, n, near, near_n): every pair of words one inserted, deleted or replaced code point
    apart, in both directions. ``vocabulary`` (word, n) must be written; its words are Latin-1."""
    spark = vocabulary.sparkSession
    filters = spark.sparkContext.broadcast(blocked_bloom.build(word_keys(vocabulary), max_bytes=filter_bytes))
    # the classes of the words allow some 90 characters at most
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), dtype=np.uint8)

    def run(batches):
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at, table in by_length(words):
                for rows, edits in _candidates(filters.value, table, alphabet):
                    yield pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), pa.array([words[i] for i in at[rows]], pa.string()),
                                                      pa.array(n[at[rows]])], names=["word", "other", "other_n"])

    positives = map_arrow(vocabulary.select("word", "n"), run, "word string, other string, other_n long")
    met = positives.join(vocabulary, "word")
    both = F.array(F.struct(F.col("word"), F.col("n"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
                   F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return met.select(F.explode(both).alias("p")).select("p.*")


# ---- forms and roots ------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form): the last of the chain."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = cut(known.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")))
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.drop("moved")


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97,
             filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per word of the texts of ``docs`` (doc_id, text; other columns are ignored) with at
    least ``min_length`` code points and ``min_count`` occurrences: word, n, n_near (words one
    edit away), form (the most frequent of those, the first in code-point order of equals, if it is at
    least ``ratio`` times as frequent; else null), form_n, root (where the chain of forms ends; the word itself
    without a form).

    Null or empty texts have no words. A null doc_id is an empty one in the checksums that decide
    which words stand with a code point less. Repeated rows count as often as they come. An
    empty table gives no rows.
    """
    vocabulary = cut(word_counts(docs, min_length, every).where(F.col("n") >= min_count))
    pairs = near_pairs(vocabulary, filter_bytes)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    close = F.col("n") * ratio <= -F.col("best.less")
    formed = cut(vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, F.col("best.word")).alias("form"), F.when(close, -F.col("best.less")).alias("form_n")))
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
