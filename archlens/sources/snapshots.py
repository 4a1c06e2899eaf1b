"""Content snapshots for incremental runs, versioned tables and append-only logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from archlens.operators.keep import keep_last


def hashed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, hash): SHA-256 of every file's content."""
    return files.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("hash"))


def difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, status): new, changed, unchanged or removed, from two tables (path, hash)."""
    old = before.select("path", F.col("hash").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old"), "changed").otherwise("unchanged")
    return now.join(old, "path", "full").select("path", status.alias("status"))


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """The files that are new or differ from the snapshot; run this before any parsing."""
    old = before.select("path", F.col("hash").alias("_old"))
    now = files.withColumn("_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).join(old, "path", "left")
    return now.where(~F.col("_hash").eqNullSafe(F.col("_old"))).drop("_hash", "_old")


def updated(before: DataFrame, now: DataFrame) -> DataFrame:
    """The snapshot after an update: new rows replace old ones of the same path."""
    both = before.withColumn("_n", F.lit(0)).unionByName(now.withColumn("_n", F.lit(1)))
    return keep_last(both, ["path"], ["_n"]).drop("_n")


def without(before: DataFrame, paths: DataFrame) -> DataFrame:
    return before.join(paths.select("path"), "path", "left_anti")


class Conflict(RuntimeError):
    """Another writer has published a version since the one that a commit was based on."""


class Versions:
    """Versioned tables in a folder, published one after the other.

    A version's data is written aside, under a name that no other writer has; it becomes a version
    when a marker with the next number is renamed into place, which fails if that number is
    taken.  Readers see markers only, so a write that failed halfway is never read.  Writers that collide
    take the next number, or get a ``Conflict`` if they said which version they started from.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self, path: Any) -> Any:
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, place: str) -> bool:
        path = self._path(place)
        return self._fs(path).exists(path)

    def versions(self, kind: str) -> list[int]:
        path = self._path(kind, "versions")
        fs = self._fs(path)
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())

    def _publish(self, kind: str, number: int, data: str) -> bool:
        """Create the marker of a number; False if it is there already."""
        jvm = self.spark.sparkContext._jvm
        aside, marker = self._path(kind, "versions", f".{uuid.uuid4().hex}"), self._path(kind, "versions", f"{number:06d}")
        out = self._fs(aside).create(aside, False)
        out.write(bytearray(data.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(aside).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, marker, kinds)  # doesn't replace what is there
        except Py4JJavaError as e:
            self._fs(aside).delete(aside, False)
            if "FileAlreadyExists" not in str(e.java_exception.getClass()):
                raise
            return False
        return True

    def write(self, kind: str, table: DataFrame, after: str | None = None) -> str:
        """Store a new version and return its id ``kind:000001``.

        With ``after``, the id of the version that the table was made from ("" for none), another
        version in between raises a ``Conflict``; what was written stays unpublished.
        """
        data = f"data/{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder}/{kind}/{data}")
        return self.publish(kind, data, after)

    def publish(self, kind: str, data: str, after: str | None = None) -> str:
        """Make a version of text ``data`` (for ``write``, the place of its files)."""
        while True:
            number = max(self.versions(kind), default=0) + 1 if after is None else int(after.rpartition(":")[2] or 0) + 1
            if self._publish(kind, number, data):
                return f"{kind}:{number:06d}"
            if after is not None:
                raise Conflict(f"{kind}:{number:06d} was published meanwhile")

    def latest(self, kind: str) -> str | None:
        found = self.versions(kind)
        return f"{kind}:{found[-1]:06d}" if found else None

    def told(self, snapshot: str) -> str:
        """What was published as a version."""
        kind, _, number = snapshot.partition(":")
        return self.spark.read.text(f"{self.folder}/{kind}/versions/{number}", wholetext=True).first()[0]

    def read(self, snapshot: str) -> DataFrame:
        kind, _, number = snapshot.partition(":")
        return self.spark.read.parquet(f"{self.folder}/{kind}/{self.told(snapshot)}")


class KeyedTable:
    """A table in a folder into which batches are merged by key, each once.

    The table lies in buckets by the hash of its keys, and a key may have several rows, which are replaced
    together.  A batch rewrites the buckets that it touches, aside, and is published as one version that
    names the files of all buckets and its own number (see ``Versions``); a batch whose number is not above
    the published one is a replay and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        self.store = Versions(spark, folder)

    def _state(self) -> tuple[str, dict]:
        latest = self.store.latest("table")
        return latest or "", json.loads(self.store.told(latest)) if latest else {"batch": -1, "files": {}}

    @property
    def batch(self) -> int:
        """The number of the last merged batch; -1 if there is none."""
        return self._state()[1]["batch"]

    def merge(self, batch: DataFrame, number: int, gone: DataFrame | None = None) -> bool:
        """Replace the rows of the batch's keys and drop those of ``gone`` (the key columns); False if the batch was merged before."""
        after, state = self._state()
        if number <= state["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.withColumn("_bucket", bucket).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            keys = rows.select(*self.keys, "_bucket")
            if gone is not None:
                keys = keys.unionByName(gone.select(*self.keys).withColumn("_bucket", bucket))
            touched = sorted(r[0] for r in keys.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
            place = f"table/data/{uuid.uuid4().hex}"
            old = [state["files"][str(b)] for b in touched if str(b) in state["files"]]
            kept = rows
            if old:
                before = self.spark.read.schema(rows.schema).parquet(*(f"{self.folder}/{p}" for p in old)).withColumn("_bucket", bucket)
                kept = rows.unionByName(before.join(keys.select(*self.keys).distinct(), self.keys, "left_anti"))
            if touched:
                kept.withColumn("_part", F.col("_bucket")).repartition("_part").write.partitionBy("_part").parquet(f"{self.folder}/{place}")
            full = {str(b): f"{place}/_part={b}" for b in touched if self.store.exists(f"{place}/_part={b}")}
            files = {b: p for b, p in state["files"].items() if int(b) not in touched} | full
            self.store.publish("table", json.dumps({"batch": number, "files": files}), after)
        finally:
            rows.unpersist()
        return True

    def read(self) -> DataFrame:
        """The rows as of the last published batch."""
        _, state = self._state()
        if not state["files"]:
            raise LookupError("the table has no rows yet")
        return self.spark.read.parquet(*(f"{self.folder}/{p}" for p in state["files"].values())).drop("_bucket")


class Log:
    """An append-only log in a folder; every ``add`` is one commit of rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)

    def read(self) -> DataFrame:
        """All rows so far, in no order; none if nothing was added."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.folder)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot (path, hash); empty if there is none."""
    try:
        return spark.read.schema("path string, hash string").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "path string, hash string")
