"""CSV files read with a quarantine (P03, T01): good rows in the declared types, all
others as (file, reason, record), so that rows in = good rows + rejected rows.

The files are read as text fields plus Spark's corrupt-record column, which holds
records with too few or too many fields; the fields are then cast one by one. A
record is rejected if its number of fields is wrong or a field is not of its type.
Rows of both outputs are decided by all columns, so a report that needs only some of
them sees the same rows as one that needs all (Spark's own permissive mode converts
and checks just the columns that a query asks for).

A null or empty field is null and no fault, in any column; an empty folder of files
gives two empty tables. Spaces around a number or time are allowed. A quote that is
never closed takes the rest of its file with it where records may span lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.sources.files import _CSV_READ
from tradelens.sources.roles import SCHEMAS, Roles

REJECT_SCHEMA = "file string, reason string, record string"
FIELDS = "number of fields"


@dataclass(frozen=True)
class Checked:
    good: DataFrame
    rejected: DataFrame


def _unused(name: str, taken: list[str]) -> str:
    """``name`` or a longer one that no column has (column names ignore case)."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> Checked:
    """The rows of ``path`` that fit ``schema``, and the records that do not."""
    names = schema.fieldNames()
    broken = _unused("_broken", names)
    why = _unused("_why", [*names, broken])
    text = T.StructType([T.StructField(n, T.StringType()) for n in (*names, broken)])
    # Without pruning: a parser that skips fields does not count them.
    raw = (spark.read.schema(text).options(**{**_CSV_READ, **options, "columnPruning": "false"})
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).csv(path))
    typed = [f for f in schema if not isinstance(f.dataType, T.StringType)]
    # Spark refuses a query that asks for nothing but the corrupt records, so one that has
    # no typed column looks at a text.
    reason = F.when(_quoted(broken).isNotNull() & F.coalesce(F.length(_quoted(names[0])) >= 0, F.lit(True)), F.lit(FIELDS))
    for f in typed:
        no_value = _quoted(f.name).isNotNull() & _quoted(f.name).try_cast(f.dataType).isNull()
        reason = reason.when(no_value, F.lit(f"{f.name}: not a {f.dataType.simpleString()}"))
    judged = raw.withColumn(why, reason)
    # try_cast: the filter and the projection may be evaluated in either order
    good = judged.where(_quoted(why).isNull()).select(
        *(_quoted(f.name).try_cast(f.dataType).alias(f.name) for f in schema))
    record = F.coalesce(_quoted(broken), F.to_csv(F.struct(*(_quoted(n) for n in names))))
    rejected = judged.where(_quoted(why).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), _quoted(why).alias("reason"), record.alias("record"))
    return Checked(good, rejected)


def read_roles_checked(spark: SparkSession, paths: dict[str, str], **options: str) -> tuple[Roles, DataFrame]:
    """The eight role tables from CSV files, good rows only, and the rejected records
    of all of them with their role. As in ``read_roles``, only reviews may hold line breaks."""
    found = {}
    for role, schema in SCHEMAS.items():
        found[role] = read_csv_checked(spark, paths[role], schema,
                                       **{"multiLine": str(role == "reviews").lower(), **options})
    rejects = [c.rejected.select(F.lit(role).alias("role"), "*") for role, c in found.items()]
    return Roles(**{role: c.good for role, c in found.items()}), reduce(DataFrame.unionAll, rejects)
