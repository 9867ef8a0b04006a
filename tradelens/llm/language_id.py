"""Language identification by word-first backoff.

A document's words are scored one by one: a word the training texts know gets,
for every language, the logarithm of its smoothed frequency there; a word they
do not know is read from left to right, taking at each place the longest known
character n-gram (5, 4, 3, 2, then 1 characters, word ends marked) and adding
up the n-grams' log frequencies. The language with the largest sum wins.

The model is fitted on a bounded sample of labelled documents
(``sample_per_language`` whole texts of each language, those with the smallest
hash of their doc_id) and holds at most ``max_words`` words, so it may be
broadcast. Prediction reads every whole text and only its text.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import cut, map_arrow, small_or_shuffled, text_or_empty

# Letters are the code points of Unicode's category L. Python's \w also takes numerals such as one
# half or a circled two; a text that has one is cut at them as well.
WORD = re.compile(r"[^\W\d_]+")
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1))
                     if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L")
_AS_SPACES = dict.fromkeys(map(ord, NUMERALS), " ")
LONGEST = 5  # characters of an n-gram
UNDETERMINED = "und"
EVIDENCE_WORDS = 32  # words a score counts at most, so that long texts do not all score 1


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii() and not NUMERALS.isdisjoint(text):
        text = text.translate(_AS_SPACES)
    return WORD.findall(text)


@dataclass
class Model:
    """Log frequencies per language. ``words`` and ``grams`` map to vectors in the
    order of ``languages``."""

    languages: list[str]
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray | None = None

    def unseen_word(self, word: str) -> np.ndarray:
        """Progressively shorter n-grams over the word with its ends marked."""
        marked, at = f"^{word}$", 0
        total = np.zeros(len(self.languages))
        while at < len(marked):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                vector = self.grams.get(marked[at:at + n])
                if vector is not None:
                    break
            else:
                n, vector = 1, self.unseen
            total += vector
            at += n
        return total


class Scorer:
    """Scores texts; remembers up to ``memory`` words it has met."""

    def __init__(self, model: Model, memory: int = 400_000):
        self.model, self.memory = model, memory
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.model.languages)))

    def _row(self, word: str) -> int:
        row = len(self.index)
        if row == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        known = self.model.words.get(word)
        self.matrix[row] = self.model.unseen_word(word) if known is None else known
        self.index[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.index) > self.memory:
            self._clear()
        index, row = self.index, self._row
        rows = [index[w] if w in index else row(w) for w in words]
        total = self.matrix[rows].sum(axis=0)
        scaled = total / len(words) * min(len(words), EVIDENCE_WORDS)
        odds = np.exp(scaled - scaled.max())
        best = int(total.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` documents of each language, those
    with the smallest hashes of their doc_id. A language's number of documents
    says which hashes can be among the smallest (with a third to spare), so the
    scan itself lets few more rows through than are kept, whatever the table's size."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    labelled = docs.where("lang is not null").select(
        F.col("lang").cast("string").alias("lang"), place.alias("place"), text_or_empty().alias("text"))
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.lit(4 * per_language / 3 + 10) / F.col("n")
    near = (labelled.join(small_or_shuffled(sizes, 10_000), "lang")
            .where(F.col("place") <= share * F.lit(float(1 << 40))))
    by_hash = Window.partitionBy("lang").orderBy("place", "text")
    return (near.withColumn("rank", F.row_number().over(by_hash))
            .where(F.col("rank") <= per_language).select("lang", "text"))


def fit(docs: DataFrame, sample_per_language: int = 1500, max_words: int = 60_000) -> Model:
    """Train on the labelled rows of ``docs`` (doc_id, text, lang). Bounds: at most
    ``sample_per_language`` documents of a language and ``max_words`` words, half of
    them dealt evenly to the languages' own most frequent ones, the others the most
    frequent of all; the n-grams are those of these words."""

    def count(batches):
        totals: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in totals.items() for w, n in c.items()]
        yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "word": [r[1] for r in rows],
                                          "n": pa.array([r[2] for r in rows], pa.int64())})

    counted = (map_arrow(training_sample(docs, sample_per_language), count, "lang string, word string, n long")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    per_word = cut(counted.groupBy("word").agg(F.sum("n").alias("total"),
                                               F.collect_list(F.struct("lang", "n")).alias("by")))
    top = _chosen(per_word, max_words).collect()
    languages = sorted({b["lang"] for r in top for b in r["by"]})
    place = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    for r in top:
        vector = np.zeros(len(languages))
        for b in r["by"]:
            vector[place[b["lang"]]] = b["n"]
        marked = f"^{r['word']}$"
        for n in range(1, LONGEST + 1):
            for i in range(len(marked) - n + 1):
                gram = marked[i:i + n]
                grams[gram] = grams[gram] + vector if gram in grams else vector
        if r["total"] > 1:  # a word met once says no more than its n-grams
            words[r["word"]] = vector
    return Model(languages, *_smoothed(words, grams, len(languages)))


def _chosen(per_word: DataFrame, max_words: int) -> DataFrame:
    """At most ``max_words`` rows of (word, total, by); no language goes without words."""
    if per_word.count() <= max_words:
        return per_word
    by_lang = per_word.select("word", F.explode("by").alias("b")).select("word", "b.lang", "b.n")
    quota = max(1, max_words // (2 * by_lang.select("lang").distinct().count()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    own = by_lang.withColumn("place", place).where(F.col("place") <= quota).groupBy("word").agg(F.min("place").alias("place"))
    return (per_word.join(own, "word", "left").orderBy(F.col("place").isNull(), F.desc("total"), "word")
            .limit(max_words).select("word", "total", "by"))


def _smoothed(words: dict, grams: dict, n_languages: int) -> tuple[dict, dict, np.ndarray]:
    """Counts to natural logarithms of additively smoothed relative frequencies,
    n-grams within their own length."""
    def logs(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not table:
            return {}
        whole = np.sum(list(table.values()), axis=0) + 0.1 * len(table)
        return {k: np.log((v + 0.1) / whole) for k, v in table.items()}

    known: dict[str, np.ndarray] = {}
    for n in range(1, LONGEST + 1):
        known.update(logs({k: v for k, v in grams.items() if len(k) == n}))
    return logs(words), known, np.full(n_languages, math.log(1e-7))


def predict_rows(docs: DataFrame, model: Model, text_col: str = "text",
                 min_score: float | None = None, carry: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. With ``min_score``, only the rows
    that have a determined language with at least that score (with a model that
    has learned nothing, those with a word), without the two columns. All columns are carried through; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = docs.columns
    schema = docs.schema if min_score is not None else \
        docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [scorer.predict(t) for t in texts]
            if min_score is None:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])
            elif not shared.value.languages:
                yield batch.filter(pa.array([bool(words_of(t or "")) for t in texts], pa.bool_()))
            else:
                yield batch.filter(pa.array([f[0] != UNDETERMINED and f[1] >= min_score for f in found], pa.bool_()))

    return map_arrow(docs, run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame, sample_per_language: int = 1500, max_words: int = 60_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row of ``docs``.

    Learns from rows with a lang whose crc32(doc_id) % 4 is not 2; those with 2
    are held out. A null or letterless text is ``und`` with score 0, as is
    every text when there is nothing to learn from. held_out is false for a null
    doc_id (which is also not learned from). Repeated rows come back as often as they come; other
    columns are ignored.
    """
    model = fit(docs.where(~held_out()), sample_per_language, max_words)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict_rows(narrow, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs``, all columns, without the rows whose language stays undetermined
    (no letters) or whose score is below ``min_score``. Even odds between many
    languages are a low score too, so by default no score is too low. Where there is
    nothing to learn from, all rows with letters stay."""
    return predict_rows(docs, fit(docs.where(~held_out())), min_score=min_score)
