"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to ``budget`` edits.  It is cut into budget + 1 pieces,
one of which must then occur unchanged.  An Aho-Corasick automaton finds all piece
hits in one pass over a text.  Around a hit, pieces are verified in pairs, then pairs of
pairs and so on: of an occurrence within budget, some hit has at most p - 1 edits in each
of its groups of p pieces, so chance hits end at the first, short groups.  What is left is
verified whole: Myers' bit-parallel algorithm finds the least edit distance of the item.
Texts and items are compared as lower case, with everything but letters and digits made
one space.

The items go to the tasks in blocks of bounded size, so a benchmark of any size
can be used; each block is one scan of the documents.

Defined results: null or empty texts match nothing, and items without a letter or
digit match nothing; equal items are reported each; rows that repeat a doc_id are
reported each; extra columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from archlens.llm.common import arrow_ddl, slices, tidied

#: Edits allowed for each character of an item.
BUDGET = 0.1
#: Characters of the items of a block.
BLOCK = 4 << 20

_REST = re.compile(r"[\W_]+")
_OUT = "doc_id long, item_id long, distance long, budget long, start long, end long"


def normalised(text: str | None) -> str:
    return " " + _REST.sub(" ", (text or "").lower()).strip() + " "


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces that cover the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A string to be found with few edits, by Myers' bit-parallel algorithm."""

    def __init__(self, text: str):
        self.size = len(text)
        self.full, self.top = (1 << self.size) - 1, 1 << (self.size - 1)
        self.equal: dict[str, int] = {}
        for i, c in enumerate(text):
            self.equal[c] = self.equal.get(c, 0) | (1 << i)

    def best(self, text: str, enough: int = 0) -> tuple[int, int]:
        """(distance, end) of the closest substring of ``text``, the first of equals; or of the first with ``enough`` edits or fewer."""
        full, top, known = self.full, self.top, self.equal.get
        plus, minus, distance = full, 0, self.size
        best, end = distance, 0
        for at, c in enumerate(text, 1):
            eq = known(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
                if distance < best:
                    best, end = distance, at
                    if best <= enough:
                        break
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
        return best, end


def best_match(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` closest to ``item``; the first of equals."""
    return Pattern(item).best(text)


class Item:
    """An item, its pieces, and the groups of two, four and more pieces that hold each of them."""

    def __init__(self, item_id: int, text: str, budget: float):
        self.item_id, self.text, self.most = item_id, text, int(len(text) * budget)
        self.pieces = pieces(text, self.most)
        self.whole = Pattern(text)
        starts = [a for a, _ in self.pieces] + [len(text)]
        self.groups: list[list[tuple[int, int, int, Pattern]]] = [[] for _ in self.pieces]  # offset, end, edits, pattern
        width = 2
        while width < len(self.pieces):
            for first in range(0, len(self.pieces), width):
                last = min(first + width, len(self.pieces))
                if last - first > width // 2:  # else the group is that of the round before
                    a, b = starts[first], starts[last]
                    group = (a, b, last - first - 1, Pattern(text[a:b]))
                    for i in range(first, last):
                        self.groups[i].append(group)
            width *= 2
        self.beside = [self._beside(i) for i in range(len(self.pieces))]

    def _beside(self, piece: int) -> list[tuple[int, str]]:
        """(offset, string) of which a piece's partner leaves one, if it has at most one edit: its half at the piece, or the other half moved by one at most."""
        other = piece ^ 1
        if other >= len(self.pieces):
            return []
        at, text = self.pieces[other]
        middle = len(text) // 2
        near, far = ((at, text[:middle]), (at + middle, text[middle:]))[:: 1 if other > piece else -1]
        return [near, *((far[0] + move, far[1]) for move in (0, -1, 1))]

    def able(self, text: str, piece: int, start: int) -> bool:
        """Whether all groups of a piece that was hit occur with their few edits; ``start`` is where the item would start."""
        if (beside := self.beside[piece]) and not any(start + at >= 0 and text.startswith(x, start + at) for at, x in beside):
            return False
        for a, b, edits, pattern in self.groups[piece]:
            if pattern.best(text[max(0, start + a - edits) : start + b + edits], edits)[0] > edits:
                return False
        return True


class Matcher:
    """Piece hits and verification for a block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items = [Item(item_id, text, budget) for item_id, text in items]
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int, int]]] = {}
        for number, item in enumerate(self.items):
            for i, (offset, piece) in enumerate(item.pieces):
                at.setdefault(piece, []).append((number, i, offset))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of the best occurrence of each item in a normalised text."""
        found: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(text):
            for number, piece, offset in places:
                start = end + 1 - length - offset  # where the item starts if nothing before the piece differs
                if number in found and found[number][0] == 0 or (number, start) in tried:
                    continue
                item = self.items[number]
                if not item.able(text, piece, start):
                    continue
                tried.add((number, start))
                most = item.most
                low, high = max(0, start - most), start + len(item.text) + most
                if start >= 0 and text.startswith(item.text, start):
                    distance, stop = 0, start + len(item.text) - low
                else:
                    distance, stop = item.whole.best(text[low:high])
                if distance <= most and distance < found.get(number, (most + 1,))[0]:
                    found[number] = (distance, max(0, low + stop - len(item.text)), low + stop)
        for number, (distance, start, stop) in found.items():
            yield self.items[number].item_id, distance, self.items[number].most, start, stop


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items as (item_id, normalised text), in blocks of BLOCK characters."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = normalised(row["text"])
        if text.strip():
            held.append((row["item_id"], text))
            size += len(text)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Rows (doc_id, item_id, distance, budget, start, end): the best occurrence of each item in each document.

    start and end count characters of the normalised text.  No shuffle.
    """
    spark = docs.sparkSession

    def one(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, schema = Matcher(shared.value, budget), arrow_ddl(_OUT)
            for batch in batches:
                for part in slices(batch):
                    rows = [
                        (doc_id, *hit)
                        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) if text
                        for hit in matcher.find(normalised(text))
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        return docs.select("doc_id", "text").mapInArrow(tidied(match), _OUT)

    found = [one(items) for items in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _OUT)
