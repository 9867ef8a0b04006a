"""File sources and sinks: the CSV hand-off of the review text
and the overwrite-a-table materialisation of a report (P04, P05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REVIEW_TEXT_SCHEMA = T.StructType([
    T.StructField("review_score", T.IntegerType()),
    T.StructField("full_review_text", T.StringType()),
])

WORD_FREQUENCY_SCHEMA = T.StructType([
    T.StructField("review_score", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("count", T.LongType()),
])

# Quoted fields may span lines and contain doubled quotes; surrounding spaces
# of a text are data and must survive the round trip.
_CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_CSV_WRITE = {"header": "true", "escape": '"', "quote": '"', "quoteAll": "true",
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = REVIEW_TEXT_SCHEMA) -> DataFrame:
    """CSV with a header, read with a declared schema (never inferred)."""
    return spark.read.schema(schema).options(**_CSV_READ).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with ``df`` as CSV part files (one per partition)."""
    df.write.mode("overwrite").options(**_CSV_WRITE).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """DROP TABLE IF EXISTS + CREATE TABLE AS in place. Spark removes the old files before the
    job runs: whoever reads meanwhile, or loses the driver, finds nothing. Tables that must
    stay readable go through :class:`tradelens.sources.versioned.VersionedTable`."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_as_table(df: DataFrame, name: str, bucket_by: str | None = None,
                  buckets: int | None = None) -> None:
    """Catalog variant of :func:`write_table`, optionally bucketed on a key so
    later joins on that key read co-partitioned files without a shuffle."""
    w = df.write.mode("overwrite").format("parquet")
    if bucket_by and buckets:
        w = w.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    w.saveAsTable(name)
