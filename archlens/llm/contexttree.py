"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions.  Every context, the last d bytes for d = 0 .. DEPTH,
has a Krichevsky-Trofimov estimate for each of the 255 decisions; context-tree
weighting mixes the estimates of all depths, the weight of a context being
one half of its own block probability against the product of its children's.

The tree holds every context of the training rows; nothing is folded or capped.
Texts are dealt into chunks of up to CHUNK_BYTES, and each chunk gives its distinct
(context, byte) keys with their training counts, so a key travels once for a chunk and
not for each place.  Keys are dealt to buckets by the last two bytes of the context and
travel packed, a chunk's keys of a bucket in one row.  A task adds up a bucket's counts
and weights the subtrees of its suffixes; the contexts of one byte and the empty one are
mixed on the driver from sums per decision, 255 for each byte value.  A bucket's log10
probabilities then meet the chunks' keys in the order of the buckets, and a chunk's texts
are scored with its own keys alone.

``learn`` and ``text_logs`` are the same model in memory, for small inputs; the tests
compare the two.

The base is a unigram model of words with add-one smoothing.  The words of a chunk travel,
are added up and come back the same way, in buckets of their own, known by 64-bit hashes.

Defined results: a null text is empty, which is its end alone; rows that repeat a
doc_id are scored each; a row without a doc_id is learned from and not held out; without training rows the byte model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import BASE, arrow_ddl, mix, saved, slices, tidied, utf8, word_bounds, word_hashes
from archlens.llm.language import training

DEPTH = 5
#: Bytes of text in a chunk (a partition of the input may hold fewer).
CHUNK_BYTES = 1 << 25
#: Keys that a task holds before it adds up equal ones.
MOST_HELD = 2_000_000
#: Keys that are weighted at once; whole suffixes of two bytes stay together.
PIECE_KEYS = 300_000
#: Ends a text and stands before its beginning; no byte of UTF-8.
EDGE = 255
#: From this bit on, a key says how many bytes of its context are folded away.
FOLDED = 56

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Model(NamedTuple):
    """A row for each context (row 0: the empty one): the context one byte further back, and log10 probabilities."""

    deeper: np.ndarray
    logs: np.ndarray


def framed(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``depth`` edges before each text and one behind; places of the scored bytes; their rows."""
    lengths = np.diff(offsets)
    out = np.full(len(data) + (depth + 1) * len(lengths), EDGE, np.uint8)
    shift = (depth + 1) * np.arange(len(lengths)) + depth
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = _LOWER[data]
    row = np.repeat(np.arange(len(lengths)), lengths + 1)
    places = np.arange(len(row)) + depth * (row + 1)
    return out, places, row


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their counts, from ascending lists."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def context_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (seen, count): seen is the next byte in the low 8 bits, above it the last byte, the one before, and so on."""
    ddl = "seen long, count long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, places, _ = framed(*utf8(part.column("text")), depth)
                keys = text[places].astype(np.int64)
                for back in range(1, depth + 1):
                    keys |= text[places - back].astype(np.int64) << (8 * back)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(keys, return_counts=True)], schema=arrow_ddl(ddl))

    return docs.select("text").mapInArrow(count, ddl).groupBy("seen").agg(F.sum("count").alias("count"))


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words, and the rows' word offsets."""
    data = _LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets)
    return word_hashes(data, starts, ends).view(np.int64), bounds


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 0.5."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):  # Stirling's series wants large arguments
        low = y < 7
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def decisions(counts: np.ndarray) -> np.ndarray:
    """(contexts, 2, 256): how often each of the decisions 1 .. 255 went to 0 and 1, from byte counts (contexts, 256)."""
    out = np.zeros((len(counts), 2, 256))
    level = counts.astype(float)
    for bit in range(8):
        nodes = 1 << (7 - bit)  # decisions of this level
        pairs = level.reshape(len(counts), nodes, 2)
        out[:, 0, nodes : 2 * nodes] = pairs[:, :, 0]
        out[:, 1, nodes : 2 * nodes] = pairs[:, :, 1]
        level = pairs.sum(axis=2)
    return out


def _share_of_ones(d: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The KT estimate of a 1; ``otherwise`` where nothing was seen."""
    n = d[:, 0] + d[:, 1]
    return np.where(n > 0, (d[:, 1] + 0.5) / (n + 1), otherwise)


def _folded_bytes(keys: np.ndarray) -> np.ndarray:
    """How many of the oldest bytes of the context are folded away."""
    return keys >> FOLDED


def _dense(keys: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (key without the next byte) that hold at least ``least``, and their byte counts."""
    contexts, index = np.unique(keys >> 8, return_inverse=True)
    heavy = np.bincount(index, counts) >= least
    number = np.cumsum(heavy) - 1
    use = heavy[index]
    out = np.zeros((int(heavy.sum()), 256))
    np.add.at(out, (number[index[use]], keys[use] & 255), counts[use])
    return contexts[heavy], out


def subtree(keys: np.ndarray, counts: np.ndarray, least: float, depth: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Weight the contexts that end with one byte.

    Contexts by depth 1 .. depth, their chances of a 1 at every decision, mixed
    from depth 1 down, and the log weighted probability of the context of depth 1.
    """
    levels, tables = [], []
    for d in range(1, depth + 1):
        known = depth - _folded_bytes(keys) >= d
        contexts, table = _dense(keys[known] & ((1 << (8 * d + 8)) - 1), counts[known], 0 if d == 1 else least)
        levels.append(contexts)
        tables.append(table)
    # bottom up: block probabilities
    own, log_own, rest, weighted = [], [], [], None
    children_log = [None] * depth
    for d in range(depth, 0, -1):
        seen = decisions(tables[d - 1])
        log = log_kt(seen[:, 0], seen[:, 1])
        if d == depth:
            weighted_here, left = log, seen
        else:
            parent = np.searchsorted(levels[d - 1], levels[d] & ((1 << (8 * d)) - 1))
            sums = np.zeros_like(log)
            np.add.at(sums, parent, weighted)
            left = seen.copy()
            np.subtract.at(left, parent, decisions(tables[d]))
            children = sums + log_kt(left[:, 0], left[:, 1])
            children_log[d - 1] = children
            weighted_here = np.logaddexp(log, children) - np.log(2)
        own.insert(0, seen)
        log_own.insert(0, log)
        rest.insert(0, left)
        weighted = weighted_here
    # top down: chances when a context is the deepest known one
    chances, above = [], None
    for d in range(1, depth + 1):
        kt = _share_of_ones(own[d - 1], np.full(own[d - 1][:, 0].shape, 0.5))
        if d == depth:
            stop = np.ones_like(kt)
        else:
            stop = 1 / (1 + np.exp(np.clip(children_log[d - 1] - log_own[d - 1], -700, 700)))
        if d == 1:
            so_far, open_ = stop * kt, 1 - stop
        else:
            parent = np.searchsorted(levels[d - 2], levels[d - 1] & ((1 << (8 * d - 8)) - 1))
            so_far, open_ = above[0][parent] + above[1][parent] * stop * kt, above[1][parent] * (1 - stop)
        below = _share_of_ones(rest[d - 1], kt)
        chances.append(so_far + open_ * below)
        above = (so_far, open_)
    return levels, chances, weighted


def byte_logs(chances: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from the chances of a 1 at the decisions."""
    p = np.clip(chances, 1e-12, 1 - 1e-12)
    out = np.zeros((len(p), 1))
    for bit in range(8):
        nodes = 1 << bit
        one = p[:, nodes : 2 * nodes]
        out = np.stack([out + np.log10(1 - one), out + np.log10(one)], axis=2).reshape(len(p), 2 * nodes)
    return out


_TREE = "depth int, context long, chances binary"


def learn(docs: DataFrame, depth: int = DEPTH, least: float = 0.0) -> Model:
    """The model of the rows of ``docs`` (text), in memory; contexts below the share ``least`` of all bytes are folded away."""
    counts = saved(context_counts(docs, depth), "contexts")
    last = F.shiftright("seen", 8).bitwiseAND(F.lit(255))
    roots = counts.groupBy(F.col("seen").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("count").alias("count")).collect()
    root = np.zeros((1, 256))
    for r in roots:
        root[0, r["byte"]] = r["count"]
    if not roots:
        return Model(np.zeros((1, 256), np.int32), np.full((1, 256), -8 * np.log10(2), np.float32))
    bound = least * root.sum()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        groups: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            held.append(batch)
        if not held:
            return
        table = pa.Table.from_batches(held)
        seen, n = table.column("seen").to_numpy(), table.column("count").to_numpy()
        group = (seen >> 8) & 255
        for b in np.unique(group):
            groups[int(b)] = [seen[group == b], n[group == b]]
        for b, (keys, n) in groups.items():
            levels, chances, weighted = subtree(keys, n, bound, depth)
            for d, (contexts, p) in enumerate(zip(levels, chances), 1):
                rows = [x.astype(np.float32).tobytes() for x in p]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(rows), pa.int32()), pa.array(contexts), pa.array(rows, pa.binary())], schema=arrow_ddl(_TREE))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b], pa.int64()), pa.array([weighted[0].tobytes()], pa.binary())], schema=arrow_ddl(_TREE))

    # rows of light contexts end in the rest of the deepest heavy one, so they travel added up
    heavy = counts
    for d in range(depth, 1, -1):
        heavy = _folded(heavy, d, bound, depth)
    found = heavy.repartition(last).mapInArrow(weigh, _TREE).toArrow()
    return _assembled(found, root, depth)


def _folded(counts: DataFrame, depth: int, bound: float, most: int) -> DataFrame:
    """Counts in which a context of ``depth`` bytes that is too light has lost its oldest byte."""
    context = F.shiftright("seen", 8).bitwiseAND(F.lit((1 << (8 * depth)) - 1))
    heavy = counts.groupBy(context.alias("context")).agg(F.sum("count").alias("n")).where(F.col("n") >= bound).select("context")
    known = counts.withColumn("context", context).join(F.broadcast(heavy.withColumn("kept", F.lit(True))), "context", "left")
    short = F.col("seen").bitwiseAND(F.lit((1 << (8 * depth)) - 1)).bitwiseOR(F.lit((most - depth + 1) << FOLDED))
    return known.select(F.when(F.col("kept"), F.col("seen")).otherwise(short).alias("seen"), "count").groupBy("seen").agg(F.sum("count").alias("count"))


def _assembled(found: pa.Table, root: np.ndarray, depth: int) -> Model:
    """Mix the root in, and link the contexts."""
    depths, contexts = found.column("depth").to_numpy(), found.column("context").to_numpy()
    rows = found.column("chances").to_pylist()
    seen = decisions(root)
    log = log_kt(seen[:, 0], seen[:, 1])[0]
    children = sum(np.frombuffer(rows[i]) for i in np.flatnonzero(depths == 0))
    stop = 1 / (1 + np.exp(np.clip(children - log, -700, 700)))
    kt = _share_of_ones(seen, np.full((1, 256), 0.5))[0]
    order = [i for d in range(1, depth + 1) for i in np.flatnonzero(depths == d)[np.argsort(contexts[depths == d])]]
    below = np.stack([np.frombuffer(rows[i], np.float32) for i in order])
    logs = np.concatenate([byte_logs(kt[None]).astype(np.float32)] + [byte_logs(stop * kt + (1 - stop) * below[a : a + 4096]).astype(np.float32) for a in range(0, len(below), 4096)])
    deeper = np.full((len(logs), 256), -1, np.int32)
    at, parents = 1, (np.array([0]), np.array([0]))
    for d in range(1, depth + 1):
        own = np.sort(contexts[depths == d])
        numbers = np.arange(at, at + len(own))
        where = np.searchsorted(parents[0], own & ((1 << (8 * (d - 1))) - 1))
        deeper[parents[1][where], own >> (8 * (d - 1))] = numbers
        at, parents = at + len(own), (own, numbers)
    return Model(deeper, logs)


def text_logs(model: Model, data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each text and its end."""
    text, places, row = framed(data, offsets, depth)
    context = np.zeros(len(places), np.int32)
    active = np.arange(len(places))
    for back in range(1, depth + 1):
        new = model.deeper[context[active], text[places[active] - back]]
        active, new = active[new >= 0], new[new >= 0]
        context[active] = new
    return np.bincount(row, model.logs[context, text[places]], len(offsets) - 1)


def context_keys(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Context and next byte of each place: the last byte on top, then the ones before, the next byte in the low 8 bits."""
    out = text[places].astype(np.int64)
    for back in range(1, depth + 1):
        out |= text[places - back].astype(np.int64) << (8 * (depth - back + 1))
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: those that are mostly zeros are squeezed by Parquet and the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def numbers(raw: bytes, kind: type = np.int64) -> np.ndarray:
    """The numbers of ``planes``."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as planes of the steps between them."""
    return planes(np.diff(keys, prepend=0))


def ascending(raw: bytes) -> np.ndarray:
    """The keys of ``steps``."""
    return np.cumsum(numbers(raw))


def _tally(keys: np.ndarray, learned: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their counts over the learned places, and those of the others with 0."""
    learned_keys, asked = np.sort(keys[learned]), np.sort(keys[~learned])
    first, first_asked = (np.flatnonzero(np.diff(x, prepend=x[:1] - 1)) for x in (learned_keys, asked))
    return [(learned_keys[first], np.diff(np.append(first, len(learned_keys)))), (asked[first_asked], np.zeros(len(first_asked), np.int64))]


def chunked(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """The rows (doc_id, text, learned), each with its chunk, and rows (chunk, bucket, keys, counts) with a chunk's keys of a bucket.

    Contexts have the buckets below ``buckets``, words as many above.  Counts are over the
    learned rows, so 0 for a key that only held-out rows have.
    """
    ddl = "chunk long, doc_id long, learned boolean, text string, bucket int, keys binary, counts binary"
    schema = arrow_ddl(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 24, 0
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        waiting = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for words, parts in enumerate(held):
                seen, count = _merged(parts)
                of = mix((seen if words else seen >> (8 * (depth - 1))).astype(np.uint64))
                bucket = (of % np.uint64(buckets)).astype(np.int32) + words * buckets
                order = np.argsort(bucket, kind="stable")
                seen, count, bucket = seen[order], count[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(seen)]])
                spans = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
                n = len(spans)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, number)), *(pa.nulls(n, schema.field(i).type) for i in (1, 2, 3)), pa.array([bucket[a] for a, _ in spans], pa.int32()),
                    pa.array([steps(seen[a:b]) for a, b in spans], pa.binary()), pa.array([planes(count[a:b]) for a, b in spans], pa.binary())], schema=schema)

        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                text, places, row = framed(data, offsets, depth)
                learned = part.column("learned").to_numpy(zero_copy_only=False)
                held[0] += _tally(context_keys(text, places, depth), learned[row])
                words, bounds = word_values(data, offsets)
                held[1] += _tally(words, np.repeat(learned, np.diff(bounds)))
                waiting += sum(len(keys) for parts in held for keys, _ in parts[-2:])
                n, size = part.num_rows, size + len(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *(part.column(c) for c in ("doc_id", "learned", "text")), *(pa.nulls(n, schema.field(i).type) for i in (4, 5, 6))], schema=schema)
                if waiting > MOST_HELD:
                    held[:], waiting = [[_merged(parts)] for parts in held], 0
                if size >= CHUNK_BYTES:
                    yield from packed()
                    held[:] = [], []
                    number, size, waiting = number + 1, 0, 0
        if held[0]:
            yield from packed()

    return rows.select("doc_id", "learned", "text").mapInArrow(tidied(cut), ddl)


class Nodes(NamedTuple):
    """The decisions after ``bit`` bits in the contexts of one depth: context << bit | bits, ascending, and how often each went to 0 and 1."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray


def _nodes(keys: np.ndarray, counts: np.ndarray, depth: int) -> dict[int, list[Nodes]]:
    """The decisions seen, of depths 2 .. depth, for ascending keys."""
    out = {}
    for d in range(depth, 1, -1):
        if d < depth:
            keys, counts = _merged([(keys >> 16 << 8 | keys & 255, counts)])
        out[d] = []
        for bit in range(8):
            node = keys >> (8 - bit)
            starts = np.flatnonzero(np.diff(node, prepend=-1))
            n, ones = (np.add.reduceat(x, starts) if len(starts) else x for x in (counts, counts * (keys >> (7 - bit) & 1)))
            out[d].append(Nodes(node[starts], n - ones, ones))
    return out


def _among(wanted: np.ndarray, ascending_keys: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are keys."""
    if not len(ascending_keys):
        return np.zeros(len(wanted), bool)
    return ascending_keys[np.minimum(np.searchsorted(ascending_keys, wanted), len(ascending_keys) - 1)] == wanted


def _parents(below: Nodes, above: Nodes, bit: int) -> np.ndarray:
    """Where the same decision is in the context that is one byte shorter."""
    return np.searchsorted(above.keys, below.keys >> (bit + 8) << bit | below.keys & ((1 << bit) - 1))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The KT estimate of a 1 (one half where nothing was seen)."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def _mixed(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of contexts, and the weight of their own estimate."""
    return np.logaddexp(own, children) - np.log(2), 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def _stops(nodes: dict[int, list[Nodes]], depth: int, bit: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The weight of the own estimate at every depth, and the log weighted probability at depth 2."""
    stops, weighted = {}, np.zeros(0)
    for d in range(depth, 1, -1):
        here = nodes[d][bit]
        own = log_kt(here.zeros.astype(float), here.ones.astype(float))
        if d == depth:
            weighted, stops[d] = own, np.ones(len(own))
        else:
            weighted, stops[d] = _mixed(own, np.bincount(_parents(nodes[d + 1][bit], here, bit), weighted, len(own)))
    return stops, weighted


class Top(NamedTuple):
    """Estimates of the empty context (256) and those of one byte (256, 256), by decision: so far, weight left to deeper ones, own."""

    so_far: np.ndarray
    open: np.ndarray
    own: np.ndarray
    so_far_1: np.ndarray
    open_1: np.ndarray
    own_1: np.ndarray
    known: np.ndarray


_SUMS = "node int, zeros long, ones long, weighted double"


def suffix_sums(keys: np.ndarray, counts: np.ndarray, depth: int) -> pa.RecordBatch:
    """For each last byte and decision (last << 8 | decision), sums over the contexts of two bytes."""
    sums = np.zeros((3, 1 << 16))
    nodes = _nodes(keys, counts, depth)
    for bit in range(8):
        _, weighted = _stops(nodes, depth, bit)
        here = nodes[2][bit]
        at = here.keys >> (bit + 8) << 8 | 1 << bit | here.keys & ((1 << bit) - 1)
        for total, x in zip(sums, (here.zeros, here.ones, weighted)):
            total += np.bincount(at, x, 1 << 16)
    used = np.flatnonzero(sums[0] + sums[1])
    zeros, ones = sums[:2, used].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(sums[2, used])], schema=arrow_ddl(_SUMS))


def top(sums: pa.Table) -> Top:
    """Mix the contexts of no and one byte from their sums (at most 256 * 255 rows)."""
    at = sums.column("node").to_numpy()
    table = np.zeros((3, 1 << 16))
    for total, name in zip(table, ("zeros", "ones", "weighted")):
        total[at] = sums.column(name).to_numpy()
    zeros, ones, below = table.reshape(3, 256, 256)
    weighted, stop_1 = _mixed(log_kt(zeros, ones), below)
    zeros_0, ones_0 = zeros.sum(axis=0), ones.sum(axis=0)
    _, stop = _mixed(log_kt(zeros_0, ones_0), weighted.sum(axis=0))
    own, own_1 = _kt(zeros_0, ones_0), _kt(zeros, ones)
    so_far, left = stop * own, 1 - stop
    return Top(so_far, left, own, so_far + left * stop_1 * own_1, left * (1 - stop_1), own_1, (zeros + ones)[:, 1] > 0)


def key_logs(keys: np.ndarray, counts: np.ndarray, model: Top, depth: int) -> np.ndarray:
    """log10 probability of the next byte of ascending keys; keys of count 0 are asked for, but teach nothing."""
    learned = counts > 0
    nodes = _nodes(keys[learned], counts[learned], depth)
    asked = keys[~learned]
    contexts = {d: asked >> (8 * (depth - d) + 8) for d in range(1, depth + 1)}
    known = {d: _among(contexts[d], nodes[d][0].keys) for d in range(2, depth + 1)}
    out = np.zeros(len(keys))
    for bit in range(8):
        stops, _ = _stops(nodes, depth, bit)
        bits = (asked & 255) >> (8 - bit)
        last, node = contexts[1], 1 << bit | bits
        of = lambda one, none: np.where(model.known[last], one[last, node], none[node])
        so, left, own = of(model.so_far_1, model.so_far), of(model.open_1, model.open), of(model.own_1, model.own)
        above = None
        for d in range(2, depth + 1):
            here = nodes[d][bit]
            kt = _kt(here.zeros, here.ones)
            if above is None:
                last, node = here.keys >> (bit + 8), 1 << bit | here.keys & ((1 << bit) - 1)
                before = model.so_far_1[last, node], model.open_1[last, node]
            else:
                at = _parents(here, nodes[d - 1][bit], bit)
                before = above[0][at], above[1][at]
            above = before[0] + before[1] * stops[d] * kt, before[1] * (1 - stops[d])
            if len(asked) and len(kt):
                wanted = contexts[d] << bit | bits
                at = np.minimum(np.searchsorted(here.keys, wanted), len(kt) - 1)
                hit = here.keys[at] == wanted
                so, left = np.where(hit, above[0][at], so), np.where(hit, above[1][at], left)
                # in a known context whose decision was never seen, all deeper estimates are one half
                own = np.where(hit, kt[at], np.where(known[d], 0.5, own))
        chance = np.empty(len(keys))
        chance[~learned] = so + left * own
        chance[learned] = above[0][np.searchsorted(nodes[depth][bit].keys, keys[learned] >> (8 - bit))]
        chance = np.clip(chance, 1e-12, 1 - 1e-12)
        out += np.log10(np.where(keys >> (7 - bit) & 1, chance, 1 - chance))
    return out


def added_up(sent: DataFrame) -> DataFrame:
    """Rows (bucket, keys, counts, known, total): the distinct keys of each bucket, how many of them were learned, and their counts' sum."""
    ddl = "bucket int, keys binary, counts binary, known long, total long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, waiting = None, 0

        def whole() -> pa.RecordBatch:
            keys, counts = _merged(held)
            row = (now, steps(keys), planes(counts), int((counts > 0).sum()), int(counts.sum()))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow_ddl(ddl))], schema=arrow_ddl(ddl))

        for batch in batches:
            for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
                if bucket != now and held:
                    yield whole()
                    held, waiting = [], 0
                now = bucket
                held.append((ascending(keys), numbers(counts)))
                waiting += len(held[-1][0])
                if waiting > MOST_HELD:
                    held, waiting = [_merged(held)], 0
        if held:
            yield whole()

    return sent.select("bucket", "keys", "counts").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(add), ddl)


def _pieces(keys: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A bucket's keys and counts in pieces that don't part contexts with the same last two bytes."""
    starts = np.flatnonzero(np.diff(keys >> (8 * (depth - 1)), prepend=-1))
    at = 0
    while at < len(keys):
        next_ = np.searchsorted(starts, at + PIECE_KEYS)
        end = int(starts[next_]) if next_ < len(starts) else len(keys)
        yield keys[at:end], counts[at:end]
        at = end


def model_rows(counts: DataFrame, depth: int) -> DataFrame:
    """Rows (bucket, keys, found) for the rows (bucket, keys, counts) of all buckets of contexts: log10 probabilities."""
    spark = counts.sparkSession

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                for keys, count in _pieces(ascending(packed), numbers(n), depth):
                    yield suffix_sums(keys[count > 0], count[count > 0], depth)

    sums = counts.mapInArrow(tidied(weigh), _SUMS).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")))
    shared = spark.sparkContext.broadcast(top(sums.toArrow()))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for bucket, packed, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
                logs = np.concatenate([key_logs(k, c, model, depth) for k, c in _pieces(ascending(packed), numbers(n), depth)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed], pa.binary()), pa.array([planes(logs)], pa.binary())], names=["bucket", "keys", "found"])

    return counts.mapInArrow(tidied(rate), "bucket int, keys binary, found binary")


def answered(sent: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """Rows (chunk, words, keys, found): the chunks' keys with what the model (bucket, keys, found) has for them, log10 probabilities of contexts and counts of words.

    A bucket's model comes before the keys of its chunks, which then pass by one after the other.
    """
    ddl = "chunk long, words boolean, keys binary, found binary"
    asked = sent.select("bucket", "chunk", "keys", F.lit(None).cast("binary").alias("found"))
    rows = model.select("bucket", F.lit(-1).cast("long").alias("chunk"), "keys", "found").unionByName(asked)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for bucket, chunk, packed, found in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "found"))):
                if found is not None:
                    known, values = ascending(packed), numbers(found, np.int64 if bucket >= buckets else np.float32)
                else:
                    row = chunk, bucket >= buckets, packed, planes(values[np.searchsorted(known, ascending(packed))])
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow_ddl(ddl))], schema=arrow_ddl(ddl))

    return rows.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidied(answer), ddl)


class Places:
    """Where each of some distinct keys is, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = free
            left = left[self.table[slot[left]] != left]
            slot[left] = self._next(slot[left])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * BASE >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return slot + 1 & (1 << self.bits) - 1

    def of(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slots(wanted)
        at = self.table[slot]
        left = np.flatnonzero(self.keys[at] != wanted)
        while len(left):
            if (at[left] < 0).any():
                raise KeyError("a chunk lacks one of its keys")
            slot[left] = self._next(slot[left])
            at[left] = self.table[slot[left]]
            left = left[self.keys[at[left]] != wanted[left]]
        return at


def score(docs: DataFrame, depth: int = DEPTH, modulus: int = 7, held: int = 2) -> DataFrame:
    """Every row, by contexts of up to depth bytes (2 .. 6), with held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(training(F.col("doc_id"), modulus, held), F.lit(True)).alias("learned"))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = saved(chunked(rows, depth, buckets), "chunks")
    texts = chunks.where("bucket IS NULL").select("chunk", "doc_id", "learned", "text")
    sent = chunks.where("bucket IS NOT NULL").select("bucket", "chunk", "keys", "counts")
    counts = saved(added_up(sent), "contexts")
    contexts, words = counts.where(F.col("bucket") < buckets), counts.where(F.col("bucket") >= buckets)
    ends = texts.where("learned").count()
    facts = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    total, distinct = facts["n"] + ends, facts["v"] + (ends > 0)
    model = model_rows(contexts, depth).unionByName(words.select("bucket", "keys", F.col("counts").alias("found")))
    asked = answered(sent, model, buckets).withColumnRenamed("chunk", "at")
    ddl = "doc_id long, held_out boolean, n_bytes long, n_words long, n_known long, logs double, score double"

    def rate(texts: pa.Table, model: pa.Table) -> pa.Table:
        of_words = model.column("words").to_numpy()
        keys, found = model.column("keys").to_pylist(), model.column("found").to_pylist()
        of = lambda kind: [i for i, w in enumerate(of_words) if w == kind]
        places = Places(np.concatenate([ascending(keys[i]) for i in of(False)]))
        byte_log = np.concatenate([numbers(found[i], np.float32) for i in of(False)])
        known = np.concatenate([np.zeros(0, np.int64), *(ascending(keys[i]) for i in of(True))])
        times = np.concatenate([np.zeros(0, np.int64), *(numbers(found[i]) for i in of(True))])
        order = np.argsort(known)
        known, times = known[order], times[order]
        times_log = np.log10(times + 1.0)
        names = [x.split()[0] for x in ddl.split(", ")]
        out = []
        for batch in texts.to_batches():
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                values, bounds = word_values(data, offsets)
                at = np.searchsorted(known, values)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                text, scored, byte_row = framed(data, offsets, depth)
                out.append(pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(~part.column("learned").to_numpy(zero_copy_only=False)), pa.array(np.diff(offsets)), pa.array(np.diff(bounds)),
                    pa.array(np.bincount(row, times[at] > 0, part.num_rows).astype(np.int64)), pa.array(np.bincount(row, times_log[at], part.num_rows)),
                    pa.array(np.bincount(byte_row, byte_log[places.of(context_keys(text, scored, depth))], part.num_rows)),
                ], names=names))
        return pa.Table.from_batches(out)

    rated = texts.groupBy("chunk").cogroup(asked.groupBy("at")).applyInArrow(rate, ddl)
    tokens = F.col("n_words") + 1
    base = F.col("logs") + F.lit(float(np.log10(ends + 1))) - tokens * F.lit(float(np.log10(total + distinct + 1)))
    return rated.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
