"""Spark session settings for the reports.

On a cluster the session comes from the platform and this module only fills
in what is missing: AQE (runtime coalescing, skew-join splitting, broadcast
switch) and a UTC session zone. Nothing here overrides a value the cluster
already set.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tradelens", folder: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark (UI off, AQE on); ``folder``
    holds what it checkpoints."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset
    (tests, a laptop), one beside the warehouse's tables."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    return (path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cluster_settings(shuffle_bytes: int, executors: int, cores_per_executor: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition sizing for a large run, derived from the expected volume of
    the largest shuffle (after pruning and partial aggregation; for the order-
    keyed reports that is roughly the item and payment columns they read).

    AQE starts from ``initialPartitionNum`` partitions of at most
    ``target_partition_bytes`` each and coalesces small ones back to the
    advisory size, so a partition always fits an executor core's memory share
    and spills only in rare skewed cases, which the skew-join split handles.
    The count is a multiple of the total core count so every wave is full.
    """
    cores = max(1, executors * cores_per_executor)
    parts = max(cores, -(-shuffle_bytes // target_partition_bytes))
    parts = -(-parts // cores) * cores
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        **SQL_DEFAULTS,
    }

