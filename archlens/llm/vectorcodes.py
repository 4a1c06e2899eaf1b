"""Vector code compression: product codes whose nearest entries are found through a VA-file.

Components become integers, vectors are cut into parts, and every part has a codebook
that starts from the vectors of the smallest ids and is refined in a few rounds; all
arithmetic is on integers.  A part's entries lie in cells (their coordinates, quantised to
a few bits); for every vector a table of the least and greatest squared distance to each
cell of each coordinate gives bounds for all entries, and only entries whose lower bound
doesn't exceed the least upper bound are compared exactly.

Spark deals the vectors; a task returns the count and the sums of each entry, at most one
row for each (part, entry), and the codebooks are the only thing that visits the driver:
``parts * entries`` rows, whatever the input's size.

Defined results: vectors that are null, or hold null or non-finite components, are left out.
Vectors of another length than the codebooks', empty ones included, stay with a null code and
error (the length is that of the first vector, by id, that ``parts`` divides).  Rows without an
id are coded and come last in the starting order; rows that share an id start in the order of
their components.  Null labels share one sum.  An empty table gives no rows, and fewer than
``entries`` vectors give a shorter codebook.  Columns besides the id, vector and label are not
read.  A component beyond 2**28 after scaling raises an error, as its error need not fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import saved, tidied

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a cell's number: so many cells a coordinate, with about equally many entries each.
BITS = 5
#: Vectors whose bounds a task holds at once.
BLOCK = 512
#: The greatest component, by its absolute value.
MOST = 1 << 28
#: A label with more than this share of the rows counts as frequent; there are fewer than its inverse.
FREQUENT = 0.001


class Cells:
    """The entries of one part's codebook, and the cells that their coordinates fall in."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        count, width = self.entries.shape
        n = min(1 << bits, count)
        cuts = np.sort(self.entries, axis=0)[np.arange(n) * count // n]
        self.cell = (self.entries[None] >= cuts[:, None]).sum(0) - 1
        self.low, self.high = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        for c in range(n):
            inside = self.cell == c
            self.low[c] = np.where(inside, self.entries, np.iinfo(np.int64).max).min(0)
            self.high[c] = np.where(inside, self.entries, np.iinfo(np.int64).min).max(0)
        empty = self.low > self.high
        self.low[empty] = self.high[empty] = 0  # no entry asks for them

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (entry, vector) of squared distances, each a sum of looked-up terms."""
        widest = int(max(np.abs(vectors).max(), np.abs(self.entries).max()))
        kind = np.int32 if (2 * widest) ** 2 * vectors.shape[1] < 2**31 else np.int64
        lower, upper = np.zeros((2, len(self.entries), len(vectors)), kind)
        for d, x in enumerate(np.ascontiguousarray(vectors.T, kind)):
            below, above = self.low[:, d].astype(kind)[:, None] - x, x - self.high[:, d].astype(kind)[:, None]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[self.cell[:, d]]
            upper += (far * far)[self.cell[:, d]]
        return lower, upper

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each vector's nearest entry, and how many entries were refined."""
        lower, upper = self.bounds(vectors)
        row, entry = np.nonzero((lower <= upper.min(0)).T)
        apart = vectors[row] - self.entries[entry]
        exact = (apart * apart).sum(1)
        first = np.searchsorted(row, np.arange(len(vectors)))
        least = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == least[row])
        return entry[hits[np.searchsorted(row[hits], np.arange(len(vectors)))]], least, len(row)


def _integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept, which of them have the width, and those as a matrix of integers."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    usable = kept & (sizes == width)
    whole = np.floor(scale * flat[np.repeat(usable, sizes)].reshape(-1, width)) if width else np.zeros((0, 0))
    if whole.size and np.abs(whole).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}")
    return kept, usable, whole.astype(np.int64)


def _blocks(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[np.ndarray]:
    whole = _integers(batch.column("_vector"), width, scale)[2]
    for at in range(0, len(whole), BLOCK):
        yield whole[at : at + BLOCK]


def _summed(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of a task's vectors."""
    parts, entries, width = books.shape
    cells = [Cells(book, bits) for book in books]
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for batch in batches:
        for block in _blocks(batch, parts * width, scale):
            for p in range(parts):
                own = block[:, p * width : (p + 1) * width]
                code, _, _ = cells[p].nearest(own)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                counts[p] += np.bincount(code, minlength=entries)
                sums[p, used] += np.add.reduceat(own[order], first, axis=0)
    part, entry = np.nonzero(counts)
    rows = pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
    yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), rows], ["part", "entry", "n", "sums"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int, bits: int) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    cells = [Cells(book, bits) for book in books]
    for batch in batches:
        kept, usable, whole = _integers(batch.column("_vector"), parts * width, scale)
        codes, errors = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
        for at in range(0, len(whole), BLOCK):
            for p in range(parts):
                code, apart, _ = cells[p].nearest(whole[at : at + BLOCK, p * width : (p + 1) * width])
                codes[at : at + BLOCK, p], errors[at : at + BLOCK] = code, errors[at : at + BLOCK] + apart
        names = iter([codes[i].tobytes().hex() for i in range(len(codes))])
        place = np.zeros(batch.num_rows, np.int64)
        place[usable] = np.arange(len(whole))
        left = np.flatnonzero(kept)
        lacks = ~usable[left]
        found = [next(names) if ok else None for ok in usable[left]]
        error = pa.array(errors[place[left]] if len(errors) else np.zeros(len(left), np.int64), pa.int64(), mask=lacks)
        rest = [batch.column(c).take(pa.array(left)) for c in batch.schema.names if c != "_vector"]
        yield pa.record_batch([*rest, pa.array(found, pa.string()), error], [c for c in batch.schema.names if c != "_vector"] + ["code", "error"])


def _narrow(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.select(F.col(f"`{vector}`").alias("_vector"))


def start(vectors: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """The first codebooks (part, entry, component): the parts of the kept vectors with the smallest ids."""
    value = F.col("_vector")
    whole = value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector")).where(whole & (F.size(value) > 0) & (F.size(value) % parts == 0))
    order = [F.col("_key").asc_nulls_last(), F.col("_vector")]
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0]["_vector"])
    rows = usable.where(F.size(value) == width).orderBy(*order).limit(entries).collect()  # at most ``entries`` rows
    whole_rows = _integers(pa.array([r["_vector"] for r in rows], pa.list_(pa.float64())), width, scale)[2]
    return np.ascontiguousarray(whole_rows.reshape(len(rows), parts, width // parts).transpose(1, 0, 2))


def fit(vectors: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds over all vectors; an entry that nothing is nearest to stays."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    books = start(vectors, key, vector, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        width = books.shape[2]
        sums = _narrow(vectors, vector).mapInArrow(tidied(partial(_summed, books=books, scale=scale, bits=bits)), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        after = books.copy()
        for row in total.collect():  # at most parts * entries rows
            after[row.part, row.entry] = [x // row.n for x in row.sums]
        books = after
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """``vectors`` with code and error in the vector's place; what holds no whole vector is left out."""
    clash = {"code", "error", "_vector"} & set(vectors.columns)
    if clash:
        raise ValueError(f"columns named {sorted(clash)} would be lost")
    rest = vectors.drop(vector)
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields]
    given = vectors.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(f"`{vector}`").alias("_vector"))
    return given.mapInArrow(tidied(partial(_coded, books=books, scale=scale, bits=bits)), ", ".join([*ddl, "code string", "error long"]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of a label's rows added up.

    A frequent label's rows are not sent to one task: such labels are few (see FREQUENT), and
    their sums are broadcast; the rows of the others meet their sums in a join.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    sums = saved(sums, "label-errors", narrow=True)
    rows = coded.agg(F.count("*")).first()[0]
    often = F.broadcast(sums.where(F.col("_n") > FREQUENT * rows).drop("_n").withColumn("_often", F.lit(True)).withColumnRenamed("label", "_label"))
    seen = coded.join(often, coded["label"].eqNullSafe(F.col("_label")), "left")
    frequent = seen.where("_often").select(*coded.columns, "label_error")
    few = sums.where(F.col("_n") <= FREQUENT * rows).drop("_n").withColumnRenamed("label", "_label")
    rare = seen.where("_often IS NULL").select(*coded.columns)
    return frequent.unionByName(rare.join(few, rare["label"].eqNullSafe(F.col("_label")), "left").select(*coded.columns, "label_error"))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all kept vectors."""
    books = fit(vectors, key, vector)
    narrow = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("_v"))
    coded = saved(encode(narrow, books, "_v"), "vector-codes", narrow=True)
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> str:
    """DuckDB SQL for ``compress``."""
    steps = []
    nearest = """(SELECT i, p, v, min(struct_pack(d := (list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c))::BIGINT, e := e)) AS x
  FROM cut JOIN book{r} USING (p) GROUP BY ALL)"""
    for r in range(rounds):
        steps.append(f"""near{r} AS MATERIALIZED {nearest.format(r=r)},
sum{r} AS (SELECT p, e, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, x.e AS e, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM near{r}) GROUP BY ALL),
new{r} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM sum{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(new{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN new{r} USING (p, e))""")
    return f"""WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT i, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
book0 AS (SELECT p, i - 1 AS e, v AS c FROM cut WHERE i <= {entries}),
{", ".join(steps)},
last AS {nearest.format(r=rounds)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', x.e), '' ORDER BY p) AS code, sum(x.d)::BIGINT AS error FROM kept JOIN last USING (i) GROUP BY vec_id, label, i)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(y, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(c)::BIGINT::VARCHAR AS y, generate_subscripts(c, 1) AS j FROM book{rounds})) AS codebooks_sha256 FROM coded"""
