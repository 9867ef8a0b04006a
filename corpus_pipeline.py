"""From documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.

Every stage reads doc_id and text (the first also lang) of its input and carries all other
columns, whatever their names. Nulls and empty texts: the first stage rejects texts without letters,
null and empty ones among them; the others take them as empty texts. An empty table gives an
empty table of the same columns. Repeated rows are equal texts: one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelens.llm.catalog import public_vocabulary
from tradelens.llm.common import cut, remove_folder, shared_path, table
from tradelens.llm.decontaminate import keep_clean
from tradelens.llm.exact_dedup import keep_rows
from tradelens.llm.language_id import keep_identified
from tradelens.llm.packing import pack
from tradelens.llm.simhash_dedup import keep_one_per_group


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest doc_id stays."""
    return keep_one_per_group(docs, shingle=3, max_distance=3)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens."""
    return pack(docs, public_vocabulary(), size=1024)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near),
          ("decontamination", clean), ("packing", packed)]

# Fingerprints, language scores and token ids are not expressible in SQL; the
# pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages are Parquet tables in
    the shared checkpoint folder, which go when the last stage's rows are written."""
    folder = shared_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    pieces = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove_folder(spark, folder)
    return pieces
