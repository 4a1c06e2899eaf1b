"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Every (key, shard) pair has a hash in (0, 1); a key goes to the shard with the
largest ``weight / -ln(hash)``.  A new shard can only win keys for itself, so
growing from n to n + 1 shards moves about 1 / (n + 1) of the keys and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 sum that make a hash: 60 bits, a positive long.
DIGITS = 15


def unit_hash(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from the key and the shard, the same in every engine with MD5."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit("#"), shard.cast("string"))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key (a null key counts as the text ``null``).

    A shard of weight 0 gets nothing.  Ties go to the larger shard number.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scored = [
        F.struct((F.lit(float(w)) / -F.log(unit_hash(key, F.lit(i)))).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights) if w > 0
    ]
    return F.array_max(F.array(*scored))["shard"]


def assign(docs: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; no shuffle, and a column of that name is replaced."""
    return docs.withColumn(shard, rendezvous(F.col(key), weights))


def slots(rows: DataFrame, shard: str, key: str, order: Sequence[str], slot: str = "slot", digits: int = 3) -> DataFrame:
    """Number the rows of each shard from 0 without gaps and without sorting a shard in one task.

    A shard is cut into 16**digits buckets by a hash of the key; rows are numbered
    inside a bucket, and the counts of the buckets before it are added.  The table
    of counts has at most shards * 16**digits rows, so it is broadcast.
    """
    from pyspark.sql import Window

    bucket = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, digits)
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(counts), [shard, "_bucket"]).withColumn(slot, F.col("_before") + F.col("_at")).drop("_bucket", "_before", "_at")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``key``.

    size is the text's UTF-8 bytes (null: none) plus 8; text_crc32 of a null text is
    that of the empty text.  Rows that repeat a doc_id share its shard and get slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col("doc_id"), [1.0] * shards).alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    out = slots(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), F.col("slot").cast("bigint"), F.col("grown_shard").cast("int"))


def oracle(shards: int = 24) -> str:
    """DuckDB SQL for ``shard_documents``; CRC-32 is computed bit by bit from its polynomial."""
    def won(n: int) -> str:
        return (
            f"(SELECT arg_max(s, (1.0 / -ln((('0x' || substr(md5(d.doc_id::VARCHAR || '#' || s::VARCHAR), 1, {DIGITS}))::BIGINT + 0.5) / 16.0**{DIGITS}))) "
            f"FROM range({n}) r(s))::INTEGER"
        )
    return f"""
WITH RECURSIVE steps AS (
  SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
base AS (SELECT doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows AS (
  SELECT d.doc_id, octet_length(encode(d.x))::BIGINT + 8 AS size,
    xor(list_reduce([b for b in list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INTEGER + 1, 2))::BIGINT))],
      lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
    {won(shards)} AS shard, {won(shards + 1)} AS grown_shard
  FROM base d, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM rows"""
