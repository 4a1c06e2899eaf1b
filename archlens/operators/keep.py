"""Keep-first and keep-last per key, ordered by an explicit column, and settled tables for loops."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the least by ``order``.  An aggregate, so partial results leave each task."""
    return _picked(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the greatest by ``order``."""
    return _picked(df, keys, order, F.max_by)


def _picked(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if rest == list(order):  # nothing but the order is kept: a plain aggregate of it
        least = F.min if pick is F.min_by else F.max
        picked = df.groupBy(*keys).agg(least(F.struct(*rest) if len(rest) > 1 else rest[0]).alias("_row"))
        return picked.select(*keys, *([F.col(f"_row.`{c}`").alias(c) for c in rest] if len(rest) > 1 else [F.col("_row").alias(rest[0])])).select(*df.columns)
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest)).select(*df.columns)


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder, so a loop's lineage doesn't grow."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the session's shared folder: for wide tables, of which each reader takes a few columns."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores by a key, for narrow rows of which much work is made: a small file is read by one task, however much its rows grow into."""
    return df.repartition(max(16, 4 * df.sparkSession.sparkContext.defaultParallelism), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine, where it is unset, a folder of the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return folder.rstrip("/")


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with its rows numbered from 0 in an order, without all of them in one task.

    Rows are dealt by ranges and numbered inside each; the counts of the ranges before, one
    number for each partition, are added.
    """
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))  # a row for each partition
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + inside).drop("_id", "_part", "_before")


def distinct_sorted(column: Column | str) -> Column:
    """An aggregate: distinct values in code-unit order, without nulls."""
    return F.sort_array(F.collect_set(column))  # compiled, where array_sort compares by a lambda
