from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.functions.text import is_word, tokens
from tradelens.operators import text_mining
from tradelens.sources.files import REVIEW_TEXT_SCHEMA, read_csv, write_csv
from tradelens.sources.stopwords import default_stop_words


def test_tokens_match_python_rules(spark):
    text = "Não-gostei! Don't, R$5,00 ÓTIMO a b"
    df = spark.createDataFrame([(text,)], "t string")
    got = [r[0] for r in df.select(F.explode(tokens(F.col("t"))).alias("w"))
           .where(is_word(F.col("w"))).collect()]
    expected = [w for w in text.lower().translate(
        str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")).split() if w.isalpha()]
    assert got == expected == ["nãogostei", "dont", "ótimo", "a", "b"]


def test_stop_words_and_top_k_ties(spark):
    rows = [(5, "zeta beta alpha the"), (5, "beta alpha zeta"), (1, None)]
    df = spark.createDataFrame(rows, "review_score int, full_review_text string")
    top = text_mining.review_word_frequency_by_score(df, default_stop_words(), k=2)
    assert [tuple(r) for r in top.collect()] == [(1, "nan", 1), (5, "alpha", 2), (5, "beta", 2)]


def test_null_score_forms_no_group(spark):
    df = spark.createDataFrame([(None, "palavra")], "review_score int, full_review_text string")
    assert text_mining.word_count_by_score(df, []).count() == 0


def test_no_python_udf_in_text_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "review_score int, full_review_text string")
    plan = text_mining.review_word_frequency_by_score(df, ["a"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_csv_round_trip_keeps_quotes_newlines_and_spaces(spark, tmp_path):
    rows = [(5, 'a "q", b\nline2'), (3, " ")]
    df = spark.createDataFrame(rows, REVIEW_TEXT_SCHEMA)
    path = str(tmp_path / "review_text")
    write_csv(df.coalesce(1), path)
    back = read_csv(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_csv_hand_off_end_to_end(spark, tmp_path):
    """R24 -> CSV (the original's manual export) -> read back -> top words -> CSV."""
    from tradelens.operators.reviews import review_text_by_score
    from tradelens.sources.files import WORD_FREQUENCY_SCHEMA
    from tradelens.sources.roles import SCHEMAS

    reviews = spark.createDataFrame(
        [("r1", "o1", 5, None, "Ótimo produto, chegou rápido!"),
         ("r2", "o2", 5, "Ótimo", "produto bom\nrecomendo"),
         ("r3", "o3", 1, None, "não gostei do produto")], SCHEMAS["reviews"])
    text_path, out_path = str(tmp_path / "review_text"), str(tmp_path / "words")
    write_csv(review_text_by_score(reviews), text_path)
    top = text_mining.review_word_frequency_by_score(read_csv(spark, text_path),
                                                     default_stop_words(), k=2)
    text_mining.export_word_frequency(top, out_path)
    back = [tuple(r) for r in read_csv(spark, out_path, WORD_FREQUENCY_SCHEMA)
            .orderBy("review_score", F.desc("count"), "word").collect()]
    assert back == [(1, "gostei", 1), (1, "produto", 1), (5, "produto", 2), (5, "ótimo", 2)]
