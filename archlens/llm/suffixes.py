"""Substring deduplication by a hash-compared suffix sort, on bytes.

Runs that share an anchor (``repeats``), each distinct one once with the number of its
copies, are compared by sorting the suffixes that start at their windows.  Prefix polynomial hashes compare any two
spans in constant time, a binary search finds how far two suffixes agree, and so
a comparison takes a logarithmic number of steps; a mergesort over all suffixes of
a shard runs level by level in numpy.  Suffixes are sorted in classes of equal key
and equal distance from the anchor, since windows of different classes can't be
equal.  Neighbours are then compared byte by byte: that proves the order, and shows which
windows are equal; a class that colliding hashes put in a wrong order is done over by its bytes.

Defined results: a null or empty text has no bytes; matches don't cross documents
and texts are judged on the input; rows that repeat a text are repeats of each
other; a row without a doc_id keeps its null; extra columns are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import BASE, BYTE_VALUE, INVERSE, arrow_ddl, powers, slices, tidied, utf8
from archlens.llm.repeats import Segment, Unit, covered, digest, identified, removal_mask, repeated_runs

#: Bytes of a window, and of the grams that anchor it.
WINDOW, GRAM = 200, 48


class SuffixSort:
    """Sorts suffixes of ``data`` by their first ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=self.prefix[1:])
        self.shift = powers(INVERSE, len(data) + 1)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes, ``depth`` at most, the suffixes at a and b have in common."""
        low = np.zeros(len(a), np.int64)
        base_a, base_b, shift_a, shift_b = self.prefix[a], self.prefix[b], self.shift[a], self.shift[b]
        step = 1 << (self.depth.bit_length() - 1)
        while step:
            reach = low + step
            fits = np.minimum(reach, self.depth)
            same = ((self.prefix[a + fits] - base_a) * shift_a == (self.prefix[b + fits] - base_b) * shift_b) & (reach <= self.depth)
            low[same] = reach[same]
            step >>= 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the suffix at a comes before that at b; ``ties`` if they agree."""
        common = self.agree(a, b)
        at = np.minimum(common, self.depth - 1)
        return np.where(common == self.depth, ties, self.data[a + at] < self.data[b + at])

    def sort(self, suffixes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Order of the suffixes inside their classes; ``classes`` must be non-decreasing."""
        n = len(suffixes)
        at = np.arange(n)
        first = np.searchsorted(classes, classes)
        size = np.searchsorted(classes, classes, "right") - first
        inside = at - first
        order, width = at.copy(), 1
        while width < size.max(initial=0):
            run = inside // width
            left = run % 2 == 0
            other_start = first + np.where(left, run + 1, run - 1) * width
            other_end = np.minimum(other_start + width, first + size)
            other_start = np.minimum(other_start, first + size)
            move = np.flatnonzero(other_end > other_start)
            low, high = other_start[move], other_end[move]
            mine, is_left = suffixes[order[move]], left[move]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                them = suffixes[order[middle]]
                smaller = np.empty(len(open_), bool)
                for side in (True, False):  # equal suffixes of the left run stay in front
                    of = is_left[open_] == side
                    smaller[of] = self.before(them[of], mine[open_][of], ties=not side)
                low[open_[smaller]] = middle[smaller] + 1
                high[open_[~smaller]] = middle[~smaller]
            place = at.copy()
            rank = low - other_start[move]
            pair = np.where(is_left, run[move], run[move] - 1)
            place[move] = first[move] + pair * width + inside[move] % width + rank
            merged = np.empty(n, np.int64)
            merged[place] = order
            order = merged
            width *= 2
        return order


def resolve(segments: list[Segment], unit: Unit) -> list[np.ndarray]:
    """The repeated windows of each segment, from neighbours in the sorted suffixes."""
    data = np.frombuffer(b"".join(s.text for s in segments), np.uint8)
    lengths = np.array([len(s.text) for s in segments])
    windows = np.array([s.windows for s in segments])
    segment = np.repeat(np.arange(len(segments)), windows)
    at = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = (np.cumsum(lengths) - lengths)[segment] + at
    _, key = np.unique(np.array([s.key for s in segments]), return_inverse=True)
    distance = np.array([s.place for s in segments])[segment] - at
    group = key[segment] * unit.window + distance
    by_class = np.argsort(group, kind="stable")
    sorter = SuffixSort(data, unit.window)
    order = by_class[sorter.sort(suffix[by_class], group[by_class])]
    same = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    a, b = order[same], order[same + 1]
    equal, wrong = np.zeros(len(a), bool), []
    spans = np.lib.stride_tricks.sliding_window_view(data, unit.window) if len(a) else None
    for i in range(0, len(a), 20_000):
        left, right = suffix[a[i : i + 20_000]], suffix[b[i : i + 20_000]]
        differ = spans[left] != spans[right]
        at = differ.argmax(axis=1)
        alike = ~differ[np.arange(len(at)), at]
        equal[i : i + 20_000] = alike
        wrong.append(~alike & (data[left + at] > data[right + at]))
    a_group = group[a]
    if len(a) and (bad := np.unique(a_group[np.concatenate(wrong)])).size:
        equal[np.isin(a_group, bad)] = False
    else:
        bad = ()
    a, b = a[equal], b[equal]
    flags = np.repeat(np.array([s.copies for s in segments]) > 1, windows)
    flags[a] = True
    flags[b] = True
    for number in bad:
        flags[np.flatnonzero(group == number)] |= _repeated_bytes(data, suffix[group == number], unit.window)
    return np.split(flags, np.cumsum(windows)[:-1])


def _repeated_bytes(data: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes agree with another one over ``depth`` bytes, by the bytes themselves."""
    texts = [data[a : a + depth].tobytes() for a in suffixes.tolist()]
    times = Counter(texts)
    return np.array([times[t] > 1 for t in texts])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    unit = Unit(False, window, gram)
    rows = identified(docs)
    joined = covered(repeated_runs(rows, unit, resolve), rows)
    ddl = "doc_id long, named boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(ddl)
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                out = []
                lists = (part.column(c).to_pylist() for c in ("doc_id", "named", "starts", "windows", "flags"))
                for row, (doc_id, named, first, windows, flags) in enumerate(zip(*lists)):
                    text = data[offsets[row] : offsets[row + 1]]
                    gone = removal_mask(len(text), first, windows, flags, window)
                    spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
                    kept = text[~gone].tobytes()
                    out.append((doc_id, named, len(text), int(gone.sum()), spans, digest(kept), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return joined.mapInArrow(tidied(cut), ddl).withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")
