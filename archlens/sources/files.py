"""Source trees, routes and manifests as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import paths
from archlens.functions.extract import EXTENSIONS
from archlens.operators.keep import keep_first, settled
from archlens.sources import tree

#: Folders that a scan never enters.
NEVER = [r"(^|/)node_modules/", r"(^|/)\.next/", r"(^|/)dist/", r"(^|/)\.generated/"]


#: The default of ``include``, and the extensions that it means.
SOURCES = (r"\.(tsx?|jsx?)$",)


def scan(spark: SparkSession, root: str, include: Sequence[str] = SOURCES, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, content): text files below ``root`` whose relative path any ``include`` finds and no ``exclude``.

    Folders in NEVER are not listed and other extensions not read (see ``tree``); on a store that only Spark
    reads, all files are read before the filter, and empty ones are left out.  Bytes that aren't UTF-8 are replaced.
    """
    if "://" in root and root.split("://")[0] not in tree.SCHEMES:
        base = root.rstrip("/")
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        tail = F.regexp_replace("path", r"^.*?" + _quoted(base.split(":", 1)[-1].lstrip("/")) + "/", "")
        found = read.select(tail.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    else:
        found = tree.tree(spark, root, [e for e in EXTENSIONS] if tuple(include) == SOURCES else ())
    wanted = F.col("path").rlike("|".join(f"(?:{p})" for p in include))
    for pattern in [*NEVER, *exclude]:
        wanted &= ~F.col("path").rlike(pattern)
    return found.where(wanted)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def numbered(files: DataFrame) -> DataFrame:
    """``files`` with ord, which rises with the path in code-unit order; only paths are sorted."""
    order = settled(files.select("path").distinct().orderBy("path").withColumn("ord", F.monotonically_increasing_id()))
    return files.join(order, "path")


def routes(files: DataFrame, app_dir: str = "app", compat: bool = False) -> DataFrame:
    """One row for each page file: path, relative_path, segment_type, its special files, parent_route, is_route_group, ord.

    Special files are looked for in the page's own folder; of several extensions the first counts.  ``files`` as from ``numbered``.
    """
    prefix = app_dir.rstrip("/") + "/"
    own = files.where(F.startswith("path", F.lit(prefix))).select(F.col("path").alias("file"), "ord", F.substring("path", len(prefix) + 1, 1 << 30).alias("inner"))
    own = own.withColumn("dir", paths.folder(F.col("inner"))).withColumn("base", F.substring_index("inner", "/", -1))
    kind = F.regexp_extract("base", r"^(page|layout|loading|error|template)\.(tsx|ts|jsx|js)$", 1)
    rank = F.array_position(F.array(*(F.lit(e) for e in EXTENSIONS)), F.concat(F.lit("."), F.substring_index("base", ".", -1)))
    special = own.withColumn("kind", kind).where("kind <> ''").withColumn("rank", rank)
    pages = special.where("kind = 'page'").select("file", "dir", "ord")
    around = keep_first(special.where("kind <> 'page'").select("dir", "kind", "rank", "file"), ["dir", "kind"], ["rank"])
    wide = around.groupBy("dir").pivot("kind", ["layout", "loading", "error", "template"]).agg(F.first("file"))
    url = paths.route_path(F.col("dir"))
    if compat:
        url = F.when(F.col("dir") == "", F.concat(F.lit("/"), F.substring_index("file", "/", -1))).otherwise(url)
    out = pages.join(wide, "dir", "left").withColumn("path", url)
    if compat:
        for c in ("layout", "loading", "error", "template"):
            out = out.withColumn(c, F.when(F.col("dir") != "", F.col(c)))
    return out.select(
        "path", F.col("file").alias("relative_path"), paths.segment_type(F.col("path"), compat).alias("segment_type"), "layout", "loading", "error", "template",
        paths.parent_route(F.col("path")).alias("parent"), paths.is_route_group(F.col("dir")).alias("is_route_group"), "ord")


def manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON manifest as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
