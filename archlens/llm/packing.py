"""Packing documents into windows by non-negative least squares on the length histogram.

Documents are tokenised once; each is cut into whole windows and one remainder.
The histogram of piece lengths (long ones rounded up to a grid) goes to the
driver: at most ``window`` numbers, however large the corpus.  There, the
combinations of up to three grid lengths that fill a window are enumerated,
non-negative least squares finds how often each should be used to match the
histogram, the counts are rounded down, and what is left of the histogram is
packed greedily, largest first.  The plan (at most a few thousand rows, bounded
by the grid) is broadcast; every piece finds its window from its rank among the
pieces of its length.  Ranks come from two-level counts, so no length is sorted
in one task.

Defined results: a null text is an empty document, which is its closing id alone;
rows that repeat a doc_id are packed each; extra columns are passed over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import IS_WHITE, arrow_ddl, saved, slices, tidied, utf8, word_bounds, word_hashes
from archlens.llm.sharding import slots

#: From this length on, lengths are rounded up to a multiple of GRID for the plan.
FINE, GRID = 256, 16
#: Parts of words whose ids a worker remembers, and the bytes up to which it does (so about 60 MB, 150 MB at most).
MOST_WORDS, MOST_BYTES = 1_200_000, 48

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words that normalising only lowers, and the parts into which the tokenizer cuts them (fixed by the tokenizer's file).
_LATIN = re.compile("[!-~\u00c0-\u00ff]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
_tokenizers: dict[str, tuple] = {}


def _inserted(array: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.insert(array, at, new.astype(array.dtype))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, longer if it is shorter than ``size``."""
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(len(array) // 2, size - len(array)), array.dtype)])


class WordIds:
    """Ids of texts under a tokenizer that treats the words between white space alone.

    The distinct parts of words in a slice are looked up once each: found by a hash in
    sorted arrays, then compared with the bytes that are stored there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.hashes = np.zeros(0, np.uint64)
        self.word_at, self.word_size, self.id_at, self.id_size = (np.zeros(0, np.int32) for _ in range(4))
        self.words, self.words_used = np.zeros(1 << 20, np.uint8), 0
        self.flat, self.used = np.zeros(1 << 20, "<u4"), 0

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Encode parts together; the ids of a part end with the only one that closes a word."""
        out: list[bytes] = []
        for at in range(0, len(parts), 20_000):
            block = parts[at : at + 20_000]
            (encoded,) = self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            ends, raw = (np.flatnonzero(self.closing[ids]) + 1).tolist(), ids.tobytes()
            if len(ends) == len(block):
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
            else:  # a part that the tokenizer cuts or drops: each goes alone
                out += map(self._alone, block)
        return out

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of new parts, and of words that could not be cut."""
        latin = _LATIN.fullmatch
        plain = [[w] if w.isalpha() and w.islower() else _PARTS.findall(w.lower()) if len(w) <= MOST_BYTES and latin(w) and "<|" not in w else None for w in words]
        plain = [x if x is None or len(x) > 1 or len(w) <= MOST_BYTES and latin(w) else None for x, w in zip(plain, words)]
        distinct = list({p: None for x in plain if x for p in x})
        known = dict(zip(distinct, self._parts(distinct)))
        return [b"".join([known[p] for p in x]) if x else self._alone(w) for w, x in zip(words, plain)]

    def _found(self, data: np.ndarray, cuts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the words data[cuts[i]:cuts[i + 1]] would stand, and whether it does."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return at, np.zeros(len(at), bool)
        at = np.minimum(at, len(self.hashes) - 1)
        size = np.diff(cuts)
        hit = (self.hashes[at] == hashes) & (self.word_size[at] == size)
        who = np.flatnonzero(hit)
        size = size[who]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = data[np.repeat(cuts[who], size) + inside] != self.words[np.repeat(self.word_at[at[who]], size) + inside]
        if differ.any():
            hit[who[np.unique(np.repeat(np.arange(len(who)), size)[differ])]] = False
        return at, hit

    def _store(self, words: list[bytes], ids: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Append the ids of new words, and remember the short ones; where their ids begin."""
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(hashes, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = hashes[order[1:]] != hashes[order[:-1]]
        keep = np.zeros(len(words), bool)
        keep[order[first]] = True
        if len(self.hashes):  # equal hashes: one word is remembered
            keep &= self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes
        keep &= lengths <= MOST_BYTES
        rank = np.concatenate([np.flatnonzero(keep), np.flatnonzero(~keep)])
        start = np.empty(len(words), np.int64)
        start[rank] = self.used + np.cumsum(sizes[rank]) - sizes[rank]
        new = np.frombuffer(b"".join([ids[i] for i in rank.tolist()]), "<u4")
        self.flat = _room(self.flat, self.used + len(new))
        self.flat[self.used : self.used + len(new)] = new
        kept = order[keep[order]]
        text_order = np.flatnonzero(keep)
        text = np.frombuffer(b"".join([words[i] for i in text_order.tolist()]), np.uint8)
        self.words = _room(self.words, self.words_used + len(text))
        self.words[self.words_used : self.words_used + len(text)] = text
        word_at = np.zeros(len(words), np.int64)
        word_at[text_order] = self.words_used + np.cumsum(lengths[text_order]) - lengths[text_order]
        at = np.searchsorted(self.hashes, hashes[kept])
        self.hashes = _inserted(self.hashes, at, hashes[kept])
        for name, values in (("word_at", word_at), ("word_size", lengths), ("id_at", start), ("id_size", sizes)):
            setattr(self, name, _inserted(getattr(self, name), at, values[kept]))
        self.words_used += len(text)
        self.used += int(sizes[keep].sum())
        return start

    def _forget(self) -> None:
        """Keep the older half, as frequent words come early."""
        old = self.word_at < self.words_used // 2
        self.hashes, self.word_at, self.word_size, self.id_at, self.id_size = (x[old] for x in (self.hashes, self.word_at, self.word_size, self.id_at, self.id_size))
        self.words_used = int((self.word_at + self.word_size).max(initial=0))
        self.used = int((self.id_at + self.id_size).max(initial=0))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        distinct, index, bounds = parts(data, offsets)
        if len(self.hashes) > MOST_WORDS:
            self._forget()
        cuts = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, distinct.offset * 8)
        flat = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        hashes = word_hashes(flat, cuts[:-1], cuts[1:])
        at, hit = self._found(flat, cuts, hashes)
        start, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[hit], sizes[hit] = self.id_at[at[hit]], self.id_size[at[hit]]
        new = np.flatnonzero(~hit)
        words = distinct.take(pa.array(new)).to_pylist()
        found = self._encoded([w.decode() for w in words])
        sizes[new] = [len(x) // 4 for x in found]
        start[new] = self._store(words, found, hashes[new])
        start, size = start[index], sizes[index]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        return np.split(ids, before[bounds[1:-1]]) if len(offsets) > 1 else []


_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
#: Bytes of words that can be cut by these kinds alone: printable ASCII but the apostrophe, and C3 before a letter of Latin-1.
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_PLAIN[[39]] = False
_LEAD = 0xC3
_AFTER_LEAD = np.zeros(256, bool)
_AFTER_LEAD[128:192] = True
_AFTER_LEAD[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_AFTER_LEAD = np.arange(256, dtype=np.uint8)
_LOWER_AFTER_LEAD[128:159] += 32


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The pieces that the tokenizer never joins: distinct ones, the number of each one's, and their offsets by row.

    Plain words are lowered and cut into runs of letters, single digits and runs of other
    signs; any other word is one piece as it is.
    """
    starts, ends, _ = word_bounds(data, offsets)
    solid = ~IS_WHITE[data]
    led = np.flatnonzero(data[:-1] == _LEAD) + 1
    odd = ~_PLAIN[data]
    odd[led - 1] = False
    odd[led] = ~_AFTER_LEAD[data[led]]
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may begin a special string
    plain = ends - starts <= MOST_BYTES
    plain[np.searchsorted(starts, np.flatnonzero(odd & solid), "right") - 1] = False
    whole = np.flatnonzero(~plain)
    size = ends[whole] - starts[whole]
    uncut = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - starts[whole], size)  # bytes of words that aren't plain
    kind = _KIND[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = solid[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    begins[uncut] = False
    begins[starts] = True
    lowered = _LOWER[data]
    lowered[led] = _LOWER_AFTER_LEAD[data[led]]
    lowered[uncut] = data[uncut]
    lowered = lowered[solid]
    first = np.flatnonzero(begins)
    cuts = np.append((np.cumsum(solid) - 1)[first], len(lowered))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(lowered))]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(first, offsets)


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """One row per piece: whole windows of a document, then its remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordIds(tokenizer)
        known, schema, end = _tokenizers[tokenizer], arrow_ddl(_PIECES), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), known.ids(*utf8(part.column("text")))):
                    ids = found.tobytes() + end
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        rows.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), total))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidied(cut), _PIECES)


def planned_length(length: Column) -> Column:
    """The length that the plan reckons with."""
    return F.when(length < FINE, length).otherwise(F.ceil(length / GRID) * GRID).cast("long")


def combinations(window: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` grid lengths that add up to the window."""
    lengths = range(-(-FINE // GRID) * GRID, window + 1, GRID)
    out: list[tuple[int, ...]] = []

    def extend(have: tuple[int, ...], room: int) -> None:
        if room == 0:
            out.append(have)
        elif len(have) < depth:
            for x in lengths:
                if x > min(room, have[-1] if have else window):
                    break
                extend((*have, x), room - x)

    extend((), window)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 that makes |a x - b| least, by active sets."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ (b - a @ x)
    for _ in range(3 * a.shape[0]):
        free = np.where(used, -np.inf, gain)
        if free.max() <= tolerance:
            break
        used[int(np.argmax(free))] = True
        while True:
            on = np.flatnonzero(used)
            try:
                z = np.linalg.solve(a[:, on].T @ a[:, on], a[:, on].T @ b)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                break
            low = z <= 0
            step = (x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)).min()
            x[on] += step * (z - x[on])
            used[on[x[on] <= 1e-12]] = False
            x[~used] = 0
        x[:] = 0
        x[on] = z
        gain = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], window: int, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """Combinations ({length: copies}, repeats) that use up the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v}
    out: list[tuple[dict[int, int], int]] = []

    def use(parts: dict[int, int], repeats: int) -> None:
        if repeats > 0:
            out.append((parts, repeats))
            for k, c in parts.items():
                left[k] -= c * repeats
                if not left[k]:
                    del left[k]

    grid = [x for x in sorted(left) if x >= FINE]
    row = {x: i for i, x in enumerate(grid)}
    columns = [c for c in combinations(window, depth) if all(x in row for x in c)]
    if columns:
        a = np.zeros((len(grid), len(columns)))
        for j, c in enumerate(columns):
            for x in c:
                a[row[x], j] += 1
        b = np.array([left[x] for x in grid], float)
        times = nnls(a, b / b.sum()) * b.sum()
        for j in np.argsort(-times, kind="stable"):
            parts = {x: columns[j].count(x) for x in columns[j]}
            use(parts, min(int(times[j] + 1e-6), *(left.get(x, 0) // c for x, c in parts.items())))
    while left:
        room, parts = window, {}
        for x in sorted(left, reverse=True):
            if n := min(room // x, left[x]):
                parts[x] = n
                room -= n * x
        use(parts, min(left[x] // c for x, c in parts.items()))
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Every piece with its window (``sequence_id``) and its place there (``offset``)."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, window, end_id), "pieces").withColumn("planned", planned_length(F.col("length")))
    histogram = {r["planned"]: r["count"] for r in cut.groupBy("planned").count().collect()}
    rows, first_id, taken = [], 0, dict.fromkeys(histogram, 0)
    for parts, repeats in plan(histogram, window):
        place = 0
        for length, copies in parts.items():
            rows.append((length, taken[length], taken[length] + copies * repeats, first_id, copies, place))
            taken[length] += copies * repeats
            place += copies
        first_id += repeats
    steps = spark.createDataFrame(rows, "planned long, low long, high long, first_id long, copies long, place long")
    cut = cut.withColumn("_piece", F.concat_ws("#", "doc_id", "start", "ids_crc32"))  # a repeated id's pieces are spread
    ranked = slots(cut, "planned", "_piece", ["doc_id", "start", "length", "ids_crc32"], "rank", digits=2)
    at = F.col("rank") - F.col("low")
    put = ranked.join(F.broadcast(steps), "planned").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_id") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("copies")).alias("part"))
    before = Window.partitionBy("sequence_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("part")
