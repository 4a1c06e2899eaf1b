"""A data source for source trees that lists before it reads.

``spark.read.format("source_tree").load(root)`` gives (path, extension, folder, size, content), path relative
to the root.  Folders that a scan never enters are not even listed, filters on path, folder,
extension and size are taken over before anything is read, and what is left is dealt to
partitions by bytes.  ``register`` makes the format known and lets Spark hand filters to it.

Options: ``bytes``, about how many bytes a partition reads (default 32 MB; a larger file is a
partition of its own); ``never``, names of folders that are skipped, separated by commas.  The tree is reached
through Arrow\'s file systems (local paths, file, hdfs, s3, gs), from the driver for the listing and from
the tasks for the contents.  Bytes that aren\'t UTF-8 are replaced, as in ``files.scan``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, extension string, folder string, size long, content string"
#: Folders that a scan never enters.
NEVER = "node_modules,.next,dist,.generated"
BYTES = 32 << 20
#: Schemes that Arrow's file systems reach.
SCHEMES = ("file", "hdfs", "s3", "gs")


@dataclass
class Files(InputPartition):
    """Files of a partition: (path, size) each."""

    files: list[tuple[str, int]]


def _facts(path: str, size: int) -> dict:
    folder, _, name = path.rpartition("/")
    return {"path": path, "extension": "." + name.rpartition(".")[2] if "." in name else "", "folder": folder, "size": size}


class TreeReader(DataSourceReader):
    def __init__(self, root: str, most: int, never: Sequence[str]):
        self.root, self.most, self.never = root.rstrip("/") or "/", most, set(never)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if _holds(f, _facts("a/b.ts", 1)) is None:
                yield f  # Spark evaluates what isn\'t known here
            else:
                self.filters.append(f)

    def _wanted(self, path: str, size: int) -> bool:
        facts = _facts(path, size)
        return all(_holds(f, facts) for f in self.filters)

    def _folders(self) -> list[str]:
        """Where listing begins: below the longest folder that a filter on path or folder asks for, else the root."""
        heads = [f.value.rpartition("/")[0] for f in self.filters if isinstance(f, StringStartsWith) and f.attribute in (("path",), ("folder",)) and "/" in f.value]
        heads += [f.value for f in self.filters if isinstance(f, EqualTo) and f.attribute == ("folder",) and f.value]
        return [max(heads, key=len)] if heads else [""]

    def listed(self) -> Iterator[tuple[str, int]]:
        """(path, size) of the wanted files; a folder is opened only if it may hold some."""
        system, top = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        todo = [f for f in self._folders() if not self.never & set(f.split("/"))]
        while todo:
            below = todo.pop()
            for info in system.get_file_info(fs.FileSelector(f"{top}/{below}" if below else top, recursive=False, allow_not_found=bool(below))):
                path = f"{below}/{info.base_name}" if below else info.base_name
                if info.type == fs.FileType.Directory and info.base_name not in self.never:
                    todo.append(path)
                elif info.type == fs.FileType.File and self._wanted(path, info.size):
                    yield path, info.size

    def partitions(self) -> list[Files]:
        parts, held = [], 0
        for path, size in sorted(self.listed()):
            if not parts or held + size > self.most:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append((path, size))
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        names = ["path", "extension", "folder", "size", "content"]
        for path, size in partition.files:
            with system.open_input_stream(f"{top}/{path}") as stream:
                content = stream.read().decode("utf-8", "replace")
            facts = _facts(path, size)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array([v], k) for v, k in zip([*(facts[n] for n in names[:4]), content], kinds)], names)


def _holds(f: Filter, facts: dict) -> bool | None:
    """Whether a file passes a filter; None if the filter is none that a listing can answer."""
    if getattr(f, "attribute", ("",))[0] not in facts or len(f.attribute) != 1:
        return None
    value = facts[f.attribute[0]]
    tests = {
        EqualTo: lambda: value == f.value, In: lambda: value in f.value, StringStartsWith: lambda: value.startswith(f.value), StringEndsWith: lambda: value.endswith(f.value),
        StringContains: lambda: f.value in value, GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value,
        LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value,
    }
    return tests[type(f)]() if type(f) in tests else None


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("bytes", BYTES)), self.options.get("never", NEVER).split(","))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def tree(spark: SparkSession, root: str, extensions: Sequence[str] = (".tsx", ".ts", ".jsx", ".js"), folder: str = "", most: int = BYTES) -> DataFrame:
    """(path, content) of the sources below a folder of a tree; without ``extensions``, of all files."""
    register(spark)
    found = spark.read.format("source_tree").option("bytes", most).load(root)
    if extensions:
        found = found.where(found["extension"].isin(*extensions))
    if folder:
        found = found.where(found["path"].startswith(folder.rstrip("/") + "/"))
    return found.select("path", "content")
