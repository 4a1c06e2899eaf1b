"""What the text operators share: work tables, Arrow slices and byte-level hashing.

Work tables are Parquet files in the folder that the session names in
``spark.checkpoint.dir``; they cut lineage and survive lost executors.  The
helpers below the tables run inside tasks and hold one slice of text at a time.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once (a longer document is one slice).
SLICE_BYTES = 1 << 20

#: The white space of the contracts' word pattern ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"

#: Tasks for each core that write a narrow table, at most.
FEW = 4
#: Work tables that a run in progress owns (see ``owned``).
_runs: list[list[str]] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; on one machine, where it is unset, a folder of the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a work table and read it back, without its lineage.

    A ``narrow`` table has a few numbers a row: it is written by FEW tasks a core at most,
    so that it doesn't become a heap of tiny files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(FEW * spark.sparkContext.defaultParallelism)
    path = f"{work_folder(spark)}/archlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _runs:
        _runs[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


class owned:
    """Own the work tables that are written inside; ``drop`` deletes them once a result that reads them is written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> "owned":
        _runs.append(self.paths)
        return self

    def __exit__(self, *failure: object) -> None:
        _runs.remove(self.paths)

    def drop(self, spark: SparkSession) -> None:
        jvm = spark.sparkContext._jvm
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(task: Task) -> Task:
    """``task``, giving the memory that it no longer uses back to the machine at its end, as workers live on."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n + 1 offsets of the rows (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Where the hashes begin: any number will do, but all tasks need the same.
SEED = 0x5DEECE66D1CE4E5B
_rng = np.random.default_rng(SEED)
#: A random 64-bit value for each byte.
BYTE_VALUE = _rng.integers(0, 2**64 - 1, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.empty(max(n, SLICE_BYTES + 4096), np.uint64)
        known[0] = 1
        known[1:] = base
        np.multiply.accumulate(known, out=known)
        if len(known) <= 2 * SLICE_BYTES:
            _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values; they find candidates, whose contents are compared afterwards."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * powers(INVERSE, len(prefix))[: max(0, len(prefix) - width)])


def chain_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """As ``gram_hashes`` with each value mixed in by itself, for hashes that stand for what they cover."""
    n = max(0, len(values) - width + 1)
    out = np.full(n, SEED ^ width, np.uint64)
    for i in range(width):
        out = mix(out * BASE + values[i : i + n])
    return out


IS_WHITE = np.zeros(256, bool)
IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the rows."""
    solid = ~IS_WHITE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight of them at a time are mixed in, all words at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) ^ np.uint64(SEED))
    active, at = np.arange(len(starts)), starts.copy()
    while len(active):
        n = np.minimum(left[active], 8).astype(np.uint64)
        block = eight[at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * n))
        out[active] = mix((out[active] ^ block) * BASE)
        left[active] -= 8
        more = left[active] > 0
        active, at = active[more], at[more] + 8
    return out


def arrow_ddl(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of our result types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def sketch(ids: DataFrame, column: str, bits: int = 23) -> DataFrame:
    """A bitmap of the hashes in ``column``: at most 2**(bits - 6) rows (word, set), however many ids there are."""
    at = F.pmod(F.col(column), F.lit(1 << bits))
    return ids.select((at / 64).cast("int").alias("_word"), (at % 64).cast("int").alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set"))


def maybe_in(df: DataFrame, column: str, bitmap: DataFrame, name: str = "maybe", bits: int = 23) -> DataFrame:
    """``df`` with a boolean that is true for every row whose hash is in the bitmap, and for few others.

    The bitmap is broadcast; its size has a fixed bound.  A full bitmap lets all rows through.
    """
    at = F.pmod(F.col(column), F.lit(1 << bits))
    with_word = df.withColumn("_at", (at / 64).cast("int"))
    joined = with_word.join(F.broadcast(bitmap), F.col("_at") == F.col("_word"), "left")
    hit = F.col("_set").isNotNull() & (F.getbit("_set", (at % 64).cast("int")) == 1)
    return joined.withColumn(name, hit).drop("_at", "_word", "_set")
