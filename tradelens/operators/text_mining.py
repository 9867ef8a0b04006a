"""Review word frequency by score (T02-T08), as one lazy Spark plan.

review text -> normalise -> split -> explode -> keep words -> count per
(score, word) -> top k per score. The counts use a map-side partial
aggregate (frequent words are absorbed before the shuffle) and the top-k
window gets a partial WindowGroupLimit before its exchange, so only k rows
per score and partition travel.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import big
from tradelens.functions.text import is_word, tokens
from tradelens.operators.heavy_hitters import top_k
from tradelens.sources.files import write_csv

# ---------------------------------------------------------------------------
# Words kept per score, and the string a missing text becomes
# (then counted as a word like any other).
# ---------------------------------------------------------------------------
TOP_K = 10
MISSING_TEXT = "nan"


def review_words(review_text: DataFrame, stop_words: Iterable[str],
                 missing_as_nan: bool = True) -> DataFrame:
    """review_score, word: one row per kept token of every review."""
    text = F.col("full_review_text").cast("string")
    if missing_as_nan:
        text = F.coalesce(text, F.lit(MISSING_TEXT))
    stop = sorted(set(stop_words))
    words = review_text.select("review_score", F.explode(tokens(text)).alias("word"))
    keep = is_word(F.col("word"))
    if stop:
        keep = keep & ~F.col("word").isin(*stop)
    return words.where(keep)


# T06 -- a NULL score forms no group (pandas' == never matches NaN).
def word_count_by_score(review_text: DataFrame, stop_words: Iterable[str],
                        missing_as_nan: bool = True) -> DataFrame:
    return (review_words(review_text.where(F.col("review_score").isNotNull()), stop_words,
                         missing_as_nan)
            .groupBy("review_score", "word")
            .agg(big(F.count(F.lit(1))).alias("count")))


# T07 -- ties at the cut are broken by the word (the notebook keeps the first
# seen in file order, which a distributed table does not have).
def top_words_by_score(word_counts: DataFrame, k: int = TOP_K) -> DataFrame:
    w = Window.partitionBy("review_score").orderBy(F.desc("count"), "word")
    return (word_counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("review_score", "word", "count"))


def review_word_frequency_by_score(review_text: DataFrame, stop_words: Iterable[str],
                                   k: int = TOP_K, missing_as_nan: bool = True) -> DataFrame:
    """T06 + T07, rows ordered by score then frequency (the export order)."""
    top = top_words_by_score(word_count_by_score(review_text, stop_words, missing_as_nan), k)
    return top.orderBy("review_score", F.desc("count"), "word")


def frequent_words_by_score(review_text: DataFrame, stop_words: Iterable[str], k: int = TOP_K,
                            missing_as_nan: bool = True) -> DataFrame:
    """T07 for vocabularies too large to shuffle: the same rows, unordered. The texts are read three times
    (``heavy_hitters``), so T06 + T07 stay the better way where the vocabulary is small."""
    words = review_words(review_text.where(F.col("review_score").isNotNull()), stop_words, missing_as_nan)
    return top_k(words, "word", k, ["review_score"]).withColumnRenamed("n", "count")


# T08 -- rows (review_score, word, count), scores ascending, as CSV part files.
def export_word_frequency(top_words: DataFrame, path: str) -> None:
    write_csv(top_words.orderBy("review_score", F.desc("count"), "word"), path)
