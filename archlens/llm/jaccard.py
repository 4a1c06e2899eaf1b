"""Near duplicates: an exact Jaccard join on word shingles with signature trees.

Nodes are distinct shingle sets, known by a 64-bit digest; copies of a set are one node.

Candidates.  Two sets that link differ in at most D = (size + size) / 9 shingles.
The shingles of a set are dealt by hash into P > D parts, P fixed for a class of
sizes; at least P - D parts of two linked sets are equal.  Taking the parts in one
global order (large parts first, empty ones last), linked sets share one of their
first D + 1 parts.  These parts are the keys; a set also uses the layout of the
next class when its partners may lie there.  A key is several shingles together,
so passages that many documents share make no key.  Keys travel packed, thousands
to a row, and a task sends a key that many of its sets have only once.

Trees.  Sets connected by keys form groups.  Passages that many texts share chain unlike
sets together, and the longest chain grows faster than the corpus; so groups above a bound
are formed anew, by those pairs of sets with a common key whose bitmaps let them link at all.
A group's sets are the leaves of a
signature tree whose nodes hold the OR of the token bitmaps and the range of sizes;
a dual traversal drops pairs of nodes whose greatest possible overlap is too small,
or that are connected already, and compares the rest exactly.  In a group
above a second bound, every set is compared with one hub first; what links with it is one
component, and only the rest is compared, in blocks, with itself and with that component.

Defined results: null or empty texts and texts without words have no shingles and
link with nothing; each such row is its own component; equal sets always link;
rows that repeat a doc_id count as one member with that id; a row without a doc_id links like any
other, but names no component, so one of such rows alone has a null id; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import arrow_ddl, chain_hashes, maybe_in, mix, saved, sketch, slices, tidied, utf8, word_bounds, word_hashes
from archlens.llm.components import components

WORDS = 5
#: Entries (key, node) that a task packs at once.
PACK = 1 << 19
#: Bytes of a group's sets that one task compares; a larger group is compared with its hub first, then in blocks of half as many.
GROUP_BYTES = 48 << 20
#: Bytes of the sets of a group that keys alone connect; a larger one is formed anew by bitmaps.
CHAIN_BYTES = 4 << 20
#: Bits of a token bitmap, children of a tree node, sets of a leaf.
BITS, FANOUT, LEAF = 2048, 8, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document."""
    data = _LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets)
    values = word_hashes(data, starts, ends)
    hashes = chain_hashes(values, width)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            h = np.sort(hashes[a : b - width + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(chain_hashes(values[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit digest of each set (0: the empty set)."""
    sums = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    sizes = np.array([len(s) for s in sets], np.uint64)
    return np.where(sizes > 0, mix(sums ^ (sizes * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1), np.uint64(0))


def part_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of all keys of all sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.frexp(sizes.astype(float))[1].astype(np.int64)  # sizes of a class: 2**(own - 1) to 2**own - 1
    out_of, keys = [], []
    for ahead in (0, 1):
        layout = own + ahead
        top = np.minimum(sizes * 5 // 4, (1 << layout) - 1)  # largest partner in this layout
        use = np.flatnonzero((sizes > 0) & (top >= np.where(ahead, 1 << (layout - 1), 1)))
        if not len(use):
            continue
        differ = (sizes + top)[use] // 9
        most = (1 << layout[use]) - 1
        parts = np.maximum((1 << layout[use]) // 3, (most + most * 5 // 4) // 9 + 1) + 1
        base = np.concatenate([[0], np.cumsum(parts)])
        tokens = np.concatenate([sets[i] for i in use])
        lengths = sizes[use]
        row = np.repeat(np.arange(len(use)), lengths)
        part = (tokens >> np.uint64(20)) % parts[row].astype(np.uint64)
        at = base[row] + part.astype(np.int64)
        held = np.bincount(at, minlength=base[-1])
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, at, mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
        part_row = np.repeat(np.arange(len(use)), parts)
        number = (np.arange(base[-1]) - base[part_row]).astype(np.uint64)
        key = mix(content ^ mix((layout[use][part_row].astype(np.uint64) << np.uint64(40)) | number))
        # one global order: by set, then large parts first, then by key
        rank = (part_row.astype(np.uint64) << np.uint64(40)) | ((255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32))
        order = np.argsort(rank, kind="stable")
        inside = np.arange(len(order)) - base[part_row]
        chosen = order[inside <= differ[part_row]]
        out_of.append(use[part_row[chosen]])
        keys.append(key[chosen])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_of), np.concatenate(keys)


def _grouped(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by key, and the first place of each key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, nodes, np.flatnonzero(first)


def _shared(keys: np.ndarray, nodes: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Pairs to pass on, and the pairs of keys with more than ``most`` nodes, whose first node alone is passed on."""
    keys, nodes, first = _grouped(keys, nodes)
    count = np.diff(np.append(first, len(keys)))
    many = np.repeat(count > most, count)
    lead = np.zeros(len(keys), bool)
    lead[first] = True
    on = ~many | lead
    return keys[on], nodes[on], keys[many], nodes[many]


_PACKED = "bucket int, settled boolean, keys binary, nodes binary"
_MEMBERS = "key long, node long, hub long"


def key_members(docs: DataFrame) -> DataFrame:
    """Rows (key, node, hub) of the keys that two nodes or more have; pairs (node, hub) connect the nodes of a key."""
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, size = arrow_ddl(_PACKED), [], 0

        def flush() -> pa.RecordBatch:
            keys, nodes, many_keys, many_nodes = _shared(*(np.concatenate(x) for x in zip(*held)), most=64)
            rows = []
            for settled, k, n in ((False, keys, nodes), (True, many_keys, many_nodes)):
                bucket = (k % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, k, n = bucket[order], k[order], n[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(k)]])
                rows += [(int(bucket[a]), settled, k[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*utf8(part.column("text")))
                of, keys = part_keys(sets)
                if len(keys):
                    held.append((keys, digests(sets)[of]))
                    size += len(keys)
                if size >= PACK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(_MEMBERS)

        def rows(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:  # in order; the first node of a key, which is held too if more may come, is the hub
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            hubs = nodes[first][np.cumsum(first) - 1]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, nodes, hubs)], schema=schema)

        def rest() -> pa.RecordBatch:
            keys, nodes, first = _grouped(*(np.concatenate(x) for x in zip(*held)))
            count = np.diff(np.append(first, len(keys)))
            several = np.repeat(count > 1, count)
            return rows(keys[several], nodes[several])

        held, size, now = [], 0, None
        for batch in batches:
            for bucket, settled, keys, nodes in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "keys", "nodes"))):
                if bucket != now and held:
                    yield rest()
                    held, size = [], 0
                now = bucket
                pair = np.frombuffer(keys, np.uint64), np.frombuffer(nodes, np.uint64)
                if settled:
                    yield rows(*pair)
                    continue
                held.append(pair)
                size += len(pair[0])
                if size > 4 * PACK:  # keys with many nodes go out, all but one node
                    keys, nodes, many_keys, many_nodes = _shared(*(np.concatenate(x) for x in zip(*held)), most=64)
                    yield rows(many_keys, many_nodes)
                    held, size = [(keys, nodes)], 0
        if held:
            yield rest()

    return docs.select("text").mapInArrow(tidied(send), _PACKED).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(meet), _MEMBERS)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and node of every row."""
    ddl = "doc_id long, text_hash long, n_shingles long, node long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*utf8(part.column("text")))
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests(sets).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_ddl(ddl))

    return docs.mapInArrow(tidied(count), ddl)


class SignatureTree:
    """Sets in leaves; every node has the OR of their bitmaps and the range of their sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        words = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            bit = s % np.uint64(BITS)
            np.bitwise_or.at(words[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.words = words
        self.excess = self.sizes - np.bitwise_count(words).sum(axis=1)
        # levels[0] are single sets; each node covers a run of the nodes below
        self.levels = [(words, self.sizes, self.sizes, self.excess)]
        self.spans = [np.stack([np.arange(len(sets)), np.arange(len(sets)) + 1], axis=1)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            below, low, high, excess = self.levels[-1]
            cut = np.arange(0, len(below), width)
            self.levels.append((np.bitwise_or.reduceat(below, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut)))
            self.spans.append(np.stack([cut, np.append(cut[1:], len(below))], axis=1))
            width = FANOUT

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the greatest overlap that nodes a and b allow is enough for a link."""
        words, low, high, excess = self.levels[level]
        overlap = np.bitwise_count(words[a] & words[b]).sum(axis=1).astype(np.int64) + np.minimum(excess[a], excess[b])
        overlap = np.minimum(overlap, np.minimum(high[a], high[b]))
        return (9 * overlap >= 4 * (low[a] + low[b])) & (5 * high[a] >= 4 * low[b]) & (5 * high[b] >= 4 * low[a])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all links do; with ``sides`` only links between two sides count (see ALL)."""
    tree = SignatureTree(sets)
    root = np.arange(len(sets))
    if sides is not None:
        tied = np.flatnonzero(sides == CONNECTED)
        root[tied] = tied[:1]
    found: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def flat() -> None:
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        """Single sets that may link: two leaves' pairs at once when there are many."""
        able = None
        if len(a) > 8:
            both = np.unique(np.concatenate([a, b]))
            _, token = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True)
            held = np.zeros((len(both), token.max() + 1), np.float32)
            held[np.repeat(np.arange(len(both)), tree.sizes[both]), token] = 1
            overlap = np.rint(held @ held.T)[np.searchsorted(both, a), np.searchsorted(both, b)]
            able = 100 * overlap >= 80 * (tree.sizes[a] + tree.sizes[b] - overlap)
            a, b = a[able], b[able]
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y and (sides is None or sides[i] != sides[j]) and (able is not None or linked(sets[i], sets[j])):
                root[max(x, y)] = min(x, y)
                found.append((i, j))

    def joined(level: int, a: int, b: int) -> bool:
        """Whether all sets below both nodes are connected already."""
        ends = []
        for node in (a, b):
            low, high = node, node + 1
            for k in range(level, 0, -1):
                low, high = tree.spans[k][low][0], tree.spans[k][high - 1][1]
            ends.append((low, high))
        flat()
        first = root[ends[0][0]]
        return bool((root[ends[0][0] : ends[0][1]] == first).all() and (root[ends[1][0] : ends[1][1]] == first).all())

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if level == 0 or joined(level, a, b):
            continue
        (a0, a1), (b0, b1) = tree.spans[level][a], tree.spans[level][b]
        i, j = np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if a == b:
            keep = i < j if level == 1 else i <= j
            i, j = i[keep], j[keep]
        able = tree.possible(level - 1, i, j)
        if level > 1:
            able |= i == j
        i, j = i[able], j[able]
        if level == 1:
            compare(i, j)
        else:  # a node with itself comes first
            order = np.argsort(i == j, kind="stable")
            stack += [(level - 1, int(i[k]), int(j[k])) for k in order]
    return found


def _stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components as stars: (node, least node) for every node but the least."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [(i, find(i)) for i in root if find(i) != i]


#: Sides of a task's sets: compared with all, on one of two sides, or on a side that is connected already.
ALL, LEFT, RIGHT, CONNECTED = -1, 0, 1, 2


def _block(rows: DataFrame, count: str) -> DataFrame:
    """``rows`` (node, label, ...) with blocks, how many its label has by its bytes in ``count``, and block, the node's own."""
    blocks = F.ceil(F.col(count) / (GROUP_BYTES // 2)).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _among(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (node, unit, side) of ``rows`` (see ``_block``): a task for each pair of a label's blocks."""
    every = rows.select("node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), ALL).when(F.col("block") < F.col("other"), LEFT).otherwise(RIGHT)
    return every.select("node", F.xxhash64(F.lit(kind), "label", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), side.alias("side"))


def _units(lost: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows (node, unit, side): the tasks of large groups.

    lost are the nodes (node, label, bytes) not linked with their hub, tied those that are.
    Pairs of blocks of lost nodes, and pairs of a block of lost with one of tied nodes,
    are a task each; tied nodes needn't be compared with each other.
    """
    lost_blocks = lost.groupBy("label").agg(F.sum("bytes").alias("lost"))
    tied_blocks = tied.groupBy("label").agg(F.sum("bytes").alias("tied"))
    counts = saved(lost_blocks.join(tied_blocks, "label", "left").withColumn("tied", F.coalesce("tied", F.lit(0))), "block_counts", narrow=True)
    left, right = _block(lost.join(counts, "label"), "lost"), _block(tied.join(counts, "label"), "tied")
    unit = lambda a, b: F.xxhash64(F.lit("tied"), "label", a, b).alias("unit")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    tied_count = F.ceil(F.col("tied") / (GROUP_BYTES // 2)).cast("int")
    from_left = left.where("tied > 0").select("node", "label", "block", each(tied_count)).select("node", unit(F.col("block"), F.col("other")), F.lit(LEFT).alias("side"))
    lost_count = F.ceil(F.col("lost") / (GROUP_BYTES // 2)).cast("int")
    from_right = right.select("node", "label", "block", each(lost_count)).select("node", unit(F.col("other"), F.col("block")), F.lit(CONNECTED).alias("side"))
    return _among(left, "lost").unionByName(from_left).unionByName(from_right)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of a set, of four to eight bits a token, 64 at least and 8192 at most; one of half as many bits is the OR of its halves."""
    bits = 1 << min(max(int(len(tokens) - 1).bit_length() + 2, 6), 13)
    words = np.zeros(bits // 64, np.uint64)
    bit = tokens % np.uint64(bits)
    np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return words.tobytes()


def may_link(sizes: np.ndarray, bitmaps: list[bytes], sides: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the sets as all pairs do whose bitmaps allow a link (between LEFT and RIGHT, where sides aren't ALL).

    From every set reached, all sets of fitting size not reached yet are looked at, so sets that go together are soon done with.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, sides = sizes[order], sides[order]
    width = min(map(len, bitmaps)) // 8
    words = np.stack([np.bitwise_or.reduce(np.frombuffer(bitmaps[i], np.uint64).reshape(-1, width), axis=0) for i in order])
    excess = sizes - np.bitwise_count(words).sum(axis=1)
    low, high = np.searchsorted(5 * sizes, 4 * sizes, "left"), np.searchsorted(4 * sizes, 5 * sizes, "right")
    new = np.ones(len(sizes), bool)
    found: list[tuple[int, int]] = []
    for start in range(len(sizes)):
        reached = [start] if new[start] else []
        new[start] = False
        while reached:
            i = reached.pop()
            others = low[i] + np.flatnonzero(new[low[i] : high[i]])
            if sides[i] != ALL:
                others = others[sides[others] != sides[i]]
            for j in (others[k : k + 65536] for k in range(0, len(others), 65536)):
                overlap = np.bitwise_count(words[i] & words[j]).sum(axis=1).astype(np.int64) + np.minimum(excess[i], excess[j])
                j = j[9 * np.minimum(overlap, np.minimum(sizes[i], sizes[j])) >= 4 * (sizes[i] + sizes[j])]
                new[j] = False
                reached += j.tolist()
                found += [(int(order[k]), int(order[i])) for k in j]
    return found


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, first_id, first_hash, ...) with the text of each; rows that repeat a doc_id and text repeat the node."""
    same = F.col("text_hash").eqNullSafe(F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    found = maybe_in(docs, "text_hash", sketch(nodes, "first_hash")).where("maybe").join(nodes, same)
    return found.select("text", *(c for c in nodes.columns if c not in ("first_id", "first_hash")))


def _likely(docs: DataFrame, members: DataFrame, chained: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``chained`` as all its pairs do that have a key in common and bitmaps that allow a link."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl("node long, n long, bitmap binary")
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl("a long, b long")
        held: list[tuple[int, int, int, bytes]] = []
        unit = None

        def flush() -> pa.RecordBatch:
            nodes, sizes, sides, bitmaps = zip(*held)
            pairs = may_link(np.array(sizes), list(bitmaps), np.array(sides))
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for now, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "n", "side", "bitmap"))):
                if now != unit and held:
                    yield flush()
                    held = []
                unit = now
                held.append(tuple(row))
        if held:
            yield flush()

    looks = _texts(docs, chained.select("node", "first_id", "first_hash")).mapInArrow(tidied(look), "node long, n long, bitmap binary")
    looks = saved(looks.dropDuplicates(["node"]), "bitmaps")
    inside = members.select("key", "node").join(looks.select("node", (F.octet_length("bitmap") + 64).cast("long").alias("bytes")), "node").distinct()
    inside = saved(inside, "chained_members", narrow=True)
    # of the keys that the same nodes have, one is enough
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    keys = inside.groupBy("key").agg(F.sum("bytes").alias("all_bytes"), *same).groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.min("all_bytes").alias("all_bytes"))
    units = _among(_block(inside.join(keys.select("key", "all_bytes"), "key").withColumnRenamed("key", "label"), "all_bytes"), "key")
    rows = units.join(looks, "node").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(tidied(compare), "a long, b long").distinct()


def _sized(nodes: DataFrame) -> DataFrame:
    """``nodes`` (label, bytes, ...) with all_bytes, those of all nodes of the label."""
    return nodes.join(nodes.groupBy("label").agg(F.sum("bytes").alias("all_bytes")), "label")


def _hub_links(sets: DataFrame, groups: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (node, label, bytes, hub, linked): each node of the large groups against the hub that shares keys with most nodes."""
    degree = near.join(groups.select(F.col("node").alias("b"), "label"), "b").groupBy("label", "b").agg(F.count("*").alias("n"))
    hub = degree.groupBy("label").agg(F.max_by("b", F.struct("n", "b")).alias("hub"))
    hubs = saved(hub.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub"), "hubs", narrow=True)
    pairs = groups.join(sets, "node").join(hubs, "label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = zip(batch.column("shingles").to_pylist(), batch.column("hub_shingles").to_pylist())
            found = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pair]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "bytes", "hub")), pa.array(found, pa.bool_())], names=["node", "label", "bytes", "hub", "linked"])

    return pairs.select("node", "label", "bytes", "hub", "shingles", "hub_shingles").mapInArrow(tidied(compare), "node long, label long, bytes long, hub long, linked boolean")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that connect them as all exact links do."""
    members = saved(key_members(docs), "members")
    near = saved(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "near", narrow=True)
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_hash")).alias("first")
    nodes = rows.join(components(near), "node").groupBy("node", "label").agg(F.max(8 * F.col("n_shingles")).alias("bytes"), first)
    nodes = saved(nodes.select("node", "label", "bytes", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "nodes", narrow=True)
    groups = saved(_sized(nodes), "sized", narrow=True)
    chained = groups.where(F.col("all_bytes") > CHAIN_BYTES)
    if not chained.isEmpty():
        likely = saved(_likely(docs, members, chained), "likely", narrow=True)
        anew = _sized(chained.drop("label", "all_bytes").join(components(likely), "node"))
        groups = saved(groups.where(F.col("all_bytes") <= CHAIN_BYTES).unionByName(anew), "sized_anew", narrow=True)
        near = near.unionByName(likely)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl("node long, unit long, shingles binary")
        for batch in batches:
            for part in slices(batch):
                sets = [s.tobytes() for s in shingle_sets(*utf8(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("unit"), pa.array(sets, pa.binary())], schema=schema)

    def sets_of(nodes: DataFrame) -> DataFrame:
        texts = _texts(docs, nodes.select("node", "first_id", "first_hash", F.col("label").alias("unit")))
        return texts.mapInArrow(tidied(shingles), "node long, unit long, shingles binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl("a long, b long")
        held: list[tuple[int, int, bytes]] = []
        unit = None

        def flush() -> pa.RecordBatch:
            sets = [np.frombuffer(s, np.uint64) for _, _, s in held]
            # similar sets next to each other: by their least shingle, then by size
            order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
            sides = np.array([held[i][1] for i in order])
            found = forest([sets[i] for i in order], None if (sides == ALL).all() else sides)
            pairs = [(held[order[i]][0], held[order[j]][0]) for i, j in found]
            if (sides == ALL).all():  # the whole group is here, so its components are known
                pairs = _stars(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        seen: set[int] = set()
        for batch in batches:
            for node, now, side, s in zip(*(batch.column(c).to_pylist() for c in ("node", "unit", "side", "shingles"))):
                if now != unit:
                    if held:
                        yield flush()
                    held, seen = [], set()
                unit = now
                if node not in seen:
                    seen.add(node)
                    held.append((node, side, s))
        if held:
            yield flush()

    # a set goes straight from its text to its group's task; only sets of large groups are written
    tasks = sets_of(groups.where(F.col("all_bytes") <= GROUP_BYTES)).withColumn("side", F.lit(ALL))
    large = groups.where(F.col("all_bytes") > GROUP_BYTES)
    stars = None
    if not large.isEmpty():
        sets = saved(sets_of(large).select("node", "shingles").dropDuplicates(["node"]), "shingles")
        against = saved(_hub_links(sets, large.select("node", "label", "bytes"), near), "against_hub")
        stars = against.where("linked AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        units = _units(against.where("NOT linked").select("node", "label", "bytes"), against.where("linked").select("node", "label", "bytes"))
        tasks = tasks.unionByName(units.join(sets, "node"))
    found = tasks.repartition("unit").sortWithinPartitions("unit").mapInArrow(tidied(join), "a long, b long")
    return found if stars is None else found.unionByName(stars)


def text_hash() -> Column:
    """The 64-bit hash of a row's text (null: empty)."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, label (equal in a component) and component_id of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), text_hash().alias("text_hash"))
    rows = saved(set_rows(docs), "sets")
    labels = components(saved(links(docs, rows), "links"))
    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = saved(labelled.where("node <> 0").groupBy("label").agg(F.min("doc_id").alias("least")), "least_ids", narrow=True)
    return labelled.join(least, "label", "left").select(
        "doc_id", "text_hash", "n_shingles", "label", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")
