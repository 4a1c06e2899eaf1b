"""Finding every window of symbols that occurs more than once in the corpus.

1. Every document is turned into runs of windows (``anchors``): a few rows a kilobyte.
2. Keys are counted with partial sums.  A key of one run can't hold a repeated window.
3. The runs of the other keys are known by 128-bit hashes of their bytes, and one
   representative of each, with the number of its copies, goes to the resolver that
   the caller gives (a suffix automaton, a suffix sort), in shards of whole keys.
   It alone says which windows are repeated, for copies as for everything else.
4. A key with more distinct runs than a shard may hold is dealt anew, by all symbols of
   each window in place of the anchor: every distinct window is then a run of its own
   with its copies, and goes to the same resolver.  So no task needs all rows of a key.
5. The repeated windows go back to their documents.

A document is known by ``doc_id`` and a hash of its text, so rows that repeat a
doc_id don't disturb each other, and rows without one are told apart by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.anchors import runs
from archlens.llm.common import BYTE_VALUE, SEED, arrow_ddl, owned, saved, slices, tidied, utf8, word_bounds, word_hashes

#: Distinct runs that a key may have; a key with more is dealt by whole windows.
MOST_RUNS = 5000
#: Bytes of distinct runs in a shard, about (a key's runs stay together).
SHARD_BYTES = 4 << 20


class Unit(NamedTuple):
    """What a symbol is, and the sizes of windows and grams."""

    words: bool
    window: int
    gram: int


class Segment(NamedTuple):
    """A distinct run: its text, the number of its copies, its windows and the anchor's place."""

    key: int
    text: bytes
    copies: int
    windows: int
    place: int


class Symbols(NamedTuple):
    """Hash values of the symbols, the rows' symbol offsets, the text with one space between words, and each symbol's first and end byte there."""

    values: np.ndarray
    bounds: np.ndarray
    raw: bytes
    begin: np.ndarray
    end: np.ndarray


#: Gives, for each segment of a shard, which of its windows occur more than once in the shard.
Resolver = Callable[[list[Segment], Unit], list[np.ndarray]]

#: What a document is known by.
DOC = ["doc_id", "named", "text_hash"]
_DOC = "doc_id long, named boolean, text_hash long"
_CONTENT = ["content", "content_2"]
_RUNS = f"{_DOC}, key long, content long, content_2 long, start int, windows int, place int"
_SEGMENTS = "key long, content long, content_2 long, text binary, copies long, windows int, place int"
_FLAGS = "key long, content long, content_2 long, flags binary"
_WINDOWS = "key long, content long, content_2 long, at int, window_key long, window_content long, text binary, copies long, place int"


def symbols(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> Symbols:
    if not unit.words:
        at = np.arange(len(data))
        return Symbols(BYTE_VALUE[data], offsets, data.tobytes(), at, at + 1)
    starts, ends, bounds = word_bounds(data, offsets)
    lengths = ends - starts
    number = np.arange(len(lengths))
    end = np.cumsum(lengths) + number
    begin = end - lengths
    spaced = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    of = np.repeat(number, lengths)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spaced[begin[of] + inside] = data[starts[of] + inside]
    return Symbols(word_hashes(data, starts, ends), bounds, spaced.tobytes(), begin, end)


def contents(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) of longs: a 128-bit hash of each raw[begin:end]."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())]), np.int64).reshape(-1, 2)


def identified(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id (null: 0), named (whether it isn't null), text (null: empty), text_hash and the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), text.alias("text"),
        F.xxhash64(text).alias("text_hash"), *keep)


def run_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """The runs of all documents."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(_RUNS)
        for batch in batches:
            for part in slices(batch):
                s = symbols(*utf8(part.column("text")), unit)
                r = runs(s.values, s.bounds, unit.window, unit.gram)
                row = np.searchsorted(s.bounds, r.start, "right") - 1
                content = contents(s.raw, s.begin[r.start], s.end[r.start + r.count + unit.window - 2])
                ids = [part.column(c).to_numpy(zero_copy_only=False)[row] for c in DOC]
                columns = [*ids, r.key.view(np.int64), content[:, 0], content[:, 1], r.start - s.bounds[row], r.count, r.place]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, safe=False) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(*DOC, "text").mapInArrow(tidied(find), _RUNS)


def _texts(reps: DataFrame, docs: DataFrame, unit: Unit) -> DataFrame:
    """The segments of one representative of each distinct run."""
    wanted = reps.groupBy(*DOC).agg(F.collect_list(F.struct("key", *_CONTENT, "copies", "windows", "place", "start")).alias("wanted"))
    rows = docs.join(wanted, DOC).dropDuplicates(DOC).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(_SEGMENTS)
        for batch in batches:
            for part in slices(batch):
                s = symbols(*utf8(part.column("text")), unit)
                lists = part.column("wanted")
                counts = np.diff(lists.offsets.to_numpy())
                flat = {f: lists.flatten().field(f) for f in ("key", *_CONTENT, "copies", "windows", "place", "start")}
                first = np.repeat(s.bounds[:-1], counts) + flat["start"].to_numpy()
                last = first + flat["windows"].to_numpy() + unit.window - 2
                texts = [s.raw[a:b] for a, b in zip(s.begin[first].tolist(), s.end[last].tolist())]
                yield pa.RecordBatch.from_arrays([flat["key"], *(flat[c] for c in _CONTENT), pa.array(texts, pa.binary()), *(flat[c] for c in ("copies", "windows", "place"))], schema=schema)

    return rows.mapInArrow(tidied(cut), _SEGMENTS)


def _resolved(segments: DataFrame, unit: Unit, resolve: Resolver) -> DataFrame:
    """Flags of the windows of each segment with a repeated window, from shards of whole keys; null where all windows are repeated."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(_FLAGS)
        held: list[tuple[tuple[int, int], Segment]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            flags = resolve([s for _, s in held], unit)
            rows = [(s.key, *c, None if f.all() else f.astype(np.uint8).tobytes()) for (c, s), f in zip(held, flags) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_CONTENT, "key", "text", "copies", "windows", "place")]
            for content, content_2, *rest in zip(*columns):
                segment = Segment(*rest)
                if size >= SHARD_BYTES and segment.key != held[-1][1].key:
                    yield flush()
                    held, size = [], 0
                held.append(((content, content_2), segment))
                size += len(segment.text)
        if held:
            yield flush()

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(shards), _FLAGS)


def _by_window(segments: DataFrame, unit: Unit, resolve: Resolver) -> DataFrame:
    """Rows (key, content, content_2, at): the repeated windows of segments whose keys have very many of them.

    A window is dealt by a hash of all its symbols, so windows of one key meet only if they are equal.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(_WINDOWS)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                s = symbols(np.frombuffer(b"".join(texts), np.uint8), offsets, unit)
                count = part.column("windows").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(count)), count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin, end = s.begin[s.bounds[row] + at], s.end[s.bounds[row] + at + unit.window - 1]
                content = contents(s.raw, begin, end)
                found = pa.array([s.raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                take = lambda c: part.column(c).to_numpy()[row]
                columns = [take("key"), *(take(c) for c in _CONTENT), at, content[:, 0], content[:, 1], found, take("copies"), take("place") - at]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, safe=False) for c, f in zip(columns, schema)], schema=schema)

    windows = saved(segments.mapInArrow(tidied(cut), _WINDOWS), "windows")
    dealt = windows.groupBy(F.col("window_key").alias("key"), F.col("window_content").alias("content")).agg(
        F.any_value("text").alias("text"), F.sum("copies").alias("copies"), F.min("place").alias("place")).where("copies > 1")
    dealt = dealt.select("key", "content", F.lit(0).cast("long").alias("content_2"), "text", "copies", F.lit(1).alias("windows"), "place")
    again = _resolved(dealt, unit, resolve).select(F.col("key").alias("window_key"), F.col("content").alias("window_content"))
    return windows.drop("text", "copies", "place").join(again, ["window_key", "window_content"]).select("key", *_CONTENT, "at")


def repeated_runs(docs: DataFrame, unit: Unit, resolve: Resolver, most_runs: int = MOST_RUNS) -> DataFrame:
    """Rows (doc_id, named, text_hash, start, windows, flags) with repeated windows; flags null: all of them.

    ``docs`` as from ``identified``.
    """
    with owned() as once:
        rows = saved(run_rows(docs, unit), "all_runs")
    # a table of its own, so that Spark can split a frequent key's rows in the join
    keys = saved(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys", narrow=True)
    shared = saved(rows.join(keys, "key"), "runs")
    once.drop(docs.sparkSession)  # nothing reads the other runs again
    first = F.min(F.struct(*DOC, "start", "windows", "place")).alias("first")
    reps = shared.groupBy("key", *_CONTENT).agg(F.count("*").alias("copies"), first).select("key", *_CONTENT, "copies", "first.*")
    # written, so that its exchange of texts and that of the result are never one that small inputs alone can share
    segments = saved(_texts(reps, docs, unit), "segments")
    frequent = segments.groupBy("key").agg(F.count("*").alias("runs")).where(F.col("runs") > most_runs).select("key")
    runs_only = shared.select(*DOC, "key", *_CONTENT, "start", "windows")
    same = ["key", *_CONTENT]
    if frequent.isEmpty():
        return runs_only.join(_resolved(segments, unit, resolve), same).select(*DOC, "start", "windows", "flags")
    frequent = saved(frequent, "frequent_keys", narrow=True)
    flags = _resolved(segments.join(frequent, "key", "left_anti"), unit, resolve)
    single = saved(_by_window(segments.join(frequent, "key", "left_semi"), unit, resolve), "repeated_windows")
    singles = runs_only.join(single, same).select(*DOC, (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("windows"), F.lit(None).cast("binary").alias("flags"))
    return runs_only.join(flags, same).select(*DOC, "start", "windows", "flags").unionByName(singles)


def covered(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text and the lists ``starts``, ``windows`` and ``flags`` of each document's repeated runs (null: none)."""
    # a set, so that rows which repeat a text add nothing
    spans = rows.groupBy(*DOC).agg(F.collect_set(F.struct("start", "windows", "flags")).alias("spans"))
    joined = docs.join(spans, DOC, "left")
    return joined.select(
        *docs.columns, F.col("spans.start").alias("starts"), F.col("spans.windows").alias("windows"), F.col("spans.flags").alias("flags"))


def removal_mask(n: int, starts: list[int] | None, windows: list[int], flags: list[bytes | None], window: int) -> np.ndarray:
    """Which of n symbols are covered by the repeated windows."""
    edge = np.zeros(n + 1, np.int64)
    for start, count, flag in zip(starts or (), windows or (), flags or ()):
        if flag is None:
            edge[start] += 1
            edge[start + count - 1 + window] -= 1
        else:
            at = start + np.flatnonzero(np.frombuffer(flag, np.uint8))
            edge[at] += 1
            edge[at + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
