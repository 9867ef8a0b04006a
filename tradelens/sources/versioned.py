"""Tables that are replaced safely (P05) and changed partition by partition.

A table is a folder::

    data/<write id>/...            what one write produced; never changed afterwards
    versions/<number>.json         a manifest: which folders the version consists of

Replacing a table writes a new data folder and then publishes a manifest under the next
number. Publishing is one rename onto a name that must not exist yet, so readers see
the old version or the new one, never a mixture or nothing; a driver that is lost
half-way leaves a data folder that no manifest names; and of two writers that
started from one version, the second fails instead of overwriting the first. Old versions stay
readable until :meth:`VersionedTable.vacuum` drops them.

A table with a partition expression keeps one folder per value of it. Deleting
rows rewrites only the partitions that hold some; the new manifest names the
others' folders as they are.

All paths go through Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = ""  # the partition label of a table without partitions
LABEL = "__part"  # the folder's column while writing; not part of the stored rows
NULL_LABEL = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name of a null label


class WriteConflict(RuntimeError):
    """Another writer published the next version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    parts: dict[str, str]  # partition label -> folder, relative to the table
    partition_by: str | None = None  # SQL expression of the label
    info: dict = field(default_factory=dict)


class _Files:
    """The few file operations a table needs, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """``text`` as the file ``name``, by one rename; fails if there is one."""
        draft = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self._path(name), self._gateway.new_array(rename, 0))
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise WriteConflict(f"{self.root}: {name} was published by another writer") from error
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, self.path)

    # ---- reading ----

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._files.names("versions") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of the given version; of the current one by default (None: nothing was published)."""
        known = self.versions()
        if version is None and not known:
            return None
        version = known[-1] if version is None else version
        return Manifest(**json.loads(self._files.read(f"versions/{version:010d}.json")))

    def read(self, version: int | None = None, labels: list[str] | None = None) -> DataFrame:
        """The rows of a version, of the named partitions only if labels are given."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return self._rows(found, labels)

    def _rows(self, found: Manifest, labels: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(found.schema))
        wanted = found.parts if labels is None else {k: v for k, v in found.parts.items() if k in set(labels)}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        # every folder is a root of its own: labels are no columns of the rows
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in wanted.values()])

    # ---- writing ----

    def replace(self, rows: DataFrame, partition_by: str | None = None, info: dict | None = None) -> Manifest:
        """DROP TABLE IF EXISTS + CREATE TABLE AS, as a new version."""
        before = self.manifest()
        return self._publish(before, rows.schema.json(), self._write(rows, partition_by), partition_by, info)

    def delete_unmatched(self, keys: DataFrame, key: str, info: dict | None = None) -> DataFrame:
        """DELETE the rows whose ``key`` is not in ``keys`` (a null key never is). Only
        partitions that hold such rows are written again, and no version is published if none
        does. Returns one row per partition before: label, rows_before, rows_deleted, rewritten."""
        before = self.manifest()
        if before is None:
            raise FileNotFoundError(f"{self.path} has no version")
        label = F.expr(before.partition_by).cast("string") if before.partition_by else F.lit(WHOLE)
        known = keys.select(key).where(F.col(key).isNotNull())
        rows = self._rows(before)
        marked = rows.join(known.distinct().withColumn("__known", F.lit(True)), key, "left")
        # one row per partition: as many as the table has folders
        counts = marked.groupBy(label.alias("label")).agg(
            F.count("*").alias("rows_before"), F.count_if(F.col("__known").isNull()).alias("rows_deleted")).collect()
        touched = [r["label"] for r in counts if r["rows_deleted"]]
        if touched:
            folders = {NULL_LABEL if t is None else t for t in touched}
            kept = self._rows(before, list(folders)).join(known, key, "left_semi")
            parts = {k: v for k, v in before.parts.items() if k not in folders}
            self._publish(before, before.schema, {**parts, **self._write(kept, before.partition_by)}, before.partition_by, info)
        return self.spark.createDataFrame(
            [(r["label"], r["rows_before"], r["rows_deleted"], r["rows_deleted"] > 0) for r in counts],
            "label string, rows_before long, rows_deleted long, rewritten boolean")

    def _write(self, rows: DataFrame, partition_by: str | None) -> dict[str, str]:
        """The rows in a new data folder; its folders by label."""
        folder = f"data/{uuid.uuid4().hex}"
        if partition_by is None:
            rows.write.parquet(f"{self.path}/{folder}")
            return {WHOLE: folder}
        # rows of a label come together first, so that a task does not write a file for each;
        # adaptive execution splits a large label and merges small ones
        labelled = rows.withColumn(LABEL, F.expr(partition_by).cast("string"))
        labelled.hint("rebalance", LABEL).write.partitionBy(LABEL).parquet(f"{self.path}/{folder}")
        marker = f"{LABEL}="
        return {self._unescaped(n[len(marker):]): f"{folder}/{n}" for n in self._files.names(folder) if n.startswith(marker)}

    def _unescaped(self, name: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)

    def _publish(self, before: Manifest | None, schema: str, parts: dict[str, str], partition_by: str | None,
                 info: dict | None) -> Manifest:
        after = Manifest((before.version if before else 0) + 1, schema, parts, partition_by, info or {})
        self._files.publish(f"versions/{after.version:010d}.json", json.dumps(after.__dict__))
        return after

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the last ``keep`` versions and every data folder that none of those
        names, left-overs of lost writers included. Not while another writer is at work."""
        numbers = self.versions()
        stay = [self.manifest(n) for n in numbers[-keep:]]
        used = {folder.split("/")[1] for m in stay for folder in m.parts.values()}
        for n in numbers[:-keep]:
            self._files.delete(f"versions/{n:010d}.json")
        gone = [n for n in self._files.names("data") if n not in used]
        for name in gone:
            self._files.delete(f"data/{name}")
        return gone

    def drop(self) -> None:
        self._files.delete("")
