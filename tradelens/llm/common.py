"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tradelens


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names in ``spark.checkpoint.dir``;
    where that is unset (tests), to a folder beside the warehouse's tables."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut there."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    use_shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint for ``df`` only if a count shows at most ``max_rows`` rows;
    beyond that the join it goes into shuffles. Give it a checkpointed table."""
    return F.broadcast(df) if df.count() <= max_rows else df


def limited(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """The same for a table of lists: a hint only if their elements sum to ``limit`` at most."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library: the package goes to the executors as a
    zip file, as ``--py-files`` would send it, once per application. The driver
    serves the file as long as it lives."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        own = _SHIPPED[sc.applicationId] = tempfile.TemporaryDirectory(prefix="tradelens-code-")
        root = Path(tradelens.__file__).resolve().parent
        tree = Path(own.name) / "tree"
        shutil.copytree(root, tree / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(own.name) / "tradelens_code"), "zip", tree))


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this library importable on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
