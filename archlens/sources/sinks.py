"""Writers: tables in a stated order under stated names, graphs by kind, and the one small document with sorted keys."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.operators import edges
from archlens.operators.keep import placed

#: Rows in a file of an ordered table.
FILE_ROWS = 200_000
#: By what each table is ordered; names and paths as the language's collation has them.
ORDER = {
    "nodes": ["id"], "components": ["id"], "routes": ["path"], "composites": ["root"], "route_intelligence": ["path"], "dependencies": ["path", "name", "target"],
    "edges": ["source", "target", "relationship"], "diagnostics": ["check_no", "node", "message"], "params": ["file", "seq", "param"],
}


def _fs(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def collated(columns: list[str], df: DataFrame) -> list[Column]:
    """The order of columns: text as the language sorts it, equal text by its code units."""
    kinds = dict(df.dtypes)
    return [c for name in columns for c in ([F.expr(f"`{name}` COLLATE UNICODE"), F.col(name)] if kinds[name] == "string" else [F.col(name)])]


def write_ordered(df: DataFrame, folder: str, order: list[str], rows: int = FILE_ROWS) -> int:
    """``df`` as JSON lines in order, in files ``000000.json`` and on of ``rows`` rows each; how many files.

    Rows are numbered over all ranges of the order, so the files hold the same bytes in every run; each is
    one task's work.  They are written aside and then renamed, and replace what the folder held.
    """
    spark = df.sparkSession
    rest = [F.to_json(F.struct(*df.columns)).alias("_all")]  # rows that are equal in the order come by all they hold
    numbered = placed(df.select(*(F.col(f"`{c}`") for c in df.columns), *rest), [*collated(order, df), F.col("_all")], "_place")
    lines = numbered.select(F.floor(F.col("_place") / rows).alias("_file"), "_place", F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    aside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    lines.repartition("_file").sortWithinPartitions("_file", "_place").drop("_place").write.partitionBy("_file").text(aside)
    place, fs = _fs(spark, folder)
    fs.delete(place, True)
    fs.mkdirs(place)
    count = 0
    for part in fs.listStatus(_fs(spark, aside)[0]):
        name = part.getPath().getName()
        if name.startswith("_file="):
            (written,) = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            fs.rename(written, _fs(spark, f"{folder}/{int(name[6:]):06d}.json")[0])
            count += 1
    fs.delete(_fs(spark, aside)[0], True)
    return count


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table in its order, in a folder of its own, and each separated graph of the edges in ``graphs``."""
    for name, df in tables.items():
        write_ordered(df, f"{folder}/{name}", [c for c in ORDER.get(name, df.columns) if c in df.columns])
    if "edges" in tables:
        for graph, own in edges.separated(tables["edges"]).items():
            write_ordered(own, f"{folder}/graphs/{graph}", ORDER["edges"])


def document(value: object) -> str:
    """JSON with keys sorted at every level, two spaces and a closing line feed; lists keep their order."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def write_summary(summary: DataFrame, path: str) -> None:
    """The one row of a summary as a document, wherever the path points."""
    place, fs = _fs(summary.sparkSession, path)
    out = fs.create(place, True)
    out.write(bytearray(document(summary.first().asDict(recursive=True)).encode()))
    out.close()
