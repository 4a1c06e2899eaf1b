"""Exact token counts at every prefix of a text, for BPE models of the sentencepiece kind.

No piece of such a model holds a space behind another character or a line feed,
and mostly none joins a Latin letter to another sign, so a text falls into chunks (spaces
and the letters or signs after them; a line feed) that are tokenised independently.  Inside a chunk, dynamic programming runs over the
prefixes: the encoding of a prefix ends with the one piece that is compatible
with the last piece of the encoding before it, two pieces being compatible when
the merge rules keep them apart.  So one left-to-right pass gives the count of
every prefix, and a chunk's counts are reused wherever it occurs.

``count_at``, ``truncate`` and the column ``cut_at`` answer budget questions from
the stored counts, without encoding again.

Defined results: a null text counts as empty; an empty text has no tokens.
Texts are never cut, whatever their length.  Rows that repeat a doc_id or have none are counted
each.  Other columns are passed over.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archlens.llm.common import arrow_ddl, slices, tidied

LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Bytes of chunks and counts that a worker remembers; beyond that the newest quarter is forgotten, as frequent chunks come early.
HELD_BYTES = 192 << 20
#: Bytes of an entry beside its chunk and counts.
ENTRY_BYTES = 100
#: Pairs of pieces whose compatibility a task remembers.
MOST_PAIRS = 2_000_000


class PrefixCounter:
    """Counts of the prefixes of texts under one model file."""

    def __init__(self, model: str, most: int = HELD_BYTES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in ids}
        bad = [p for p in self.score if "\n" in p or " " in p.lstrip(" ")]
        if bad:
            raise ValueError(f"pieces that cross chunks: {bad[:3]}")
        # where no piece joins a Latin letter to anything but letters and spaces before them, a run of letters is a chunk
        latin = re.compile(f"[{LATIN}]")
        joins = any(a != " " and bool(latin.match(a)) != bool(latin.match(b)) for p in self.score for a, b in zip(p, p[1:]))
        self.chunks = re.compile(r" *[^ \n]+|\n| +" if joins else rf" *[{LATIN}]+| *[^ \n{LATIN}]+|\n| +")
        self.apart: dict[tuple[str, str], bool] = {}
        # every beginning of a piece, and whether it is a piece that the rules make
        self.start = {p[:i]: False for p in self.score for i in range(1, len(p))}
        self.start |= {p: self.merged(p) == [p] for p in self.score}
        self.known: dict[str, bytes] = {}
        self.held, self.most = 0, most

    def merged(self, text: str) -> list[str]:
        """The pieces that the merge rules make of a short text."""
        parts = list(text)
        while True:
            found = [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found:
                return parts
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > MOST_PAIRS:
                self.apart.clear()
            known = self.apart[left, right] = self.merged(left + right) == [left, right]
        return known

    def deltas(self, chunk: str) -> bytes:
        """For every character, by how much it changes the count (signed bytes)."""
        n = len(chunk)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        known, apart = self.start, self.apart
        for at in range(n):
            before, count = last[at], counts[at] + 1
            for end in range(at + 1, n + 1):
                piece = chunk[at:end]
                whole = known.get(piece)
                if whole is None:
                    break
                if whole and not last[end]:
                    fits = not before or apart.get((before, piece))
                    if fits is None:
                        fits = self.compatible(before, piece)
                    if fits:
                        counts[end], last[end] = count, piece
            if not counts[at + 1]:  # no piece ends here: the character's bytes stand for it
                counts[at + 1] = counts[at] + len(chunk[at].encode("utf-8", "surrogatepass"))
        return array("b", map(int.__sub__, counts[1:], counts)).tobytes()

    def forget(self) -> None:
        """Keep the oldest chunks, up to three quarters of the bytes that may be held."""
        kept, self.held = {}, 0
        for chunk, made in self.known.items():
            size = ENTRY_BYTES + getsizeof(chunk) + getsizeof(made)
            if self.held + size <= self.most * 3 // 4:
                kept[chunk] = made
                self.held += size
        self.known = kept

    def prefix_deltas(self, text: str) -> np.ndarray:
        """Entry p: tokens of text[:p + 1] less those of text[:p]."""
        if not text:
            return np.zeros(0, np.int8)
        chunks = self.chunks.findall(" " + text.replace("▁", " "))
        known = self.known
        try:
            joined = b"".join([known[c] for c in chunks])
        except KeyError:
            for c in chunks:
                if c not in known:
                    known[c] = made = self.deltas(c)
                    self.held += ENTRY_BYTES + getsizeof(c) + getsizeof(made)
            joined = b"".join([known[c] for c in chunks])
            if self.held > self.most:
                self.forget()
        out = np.frombuffer(joined, np.int8)
        first = out[1:2] + out[0]
        return np.concatenate([first, out[2:]])


def count_at(deltas: bytes, prefix: int) -> int:
    """Tokens of the first ``prefix`` code points."""
    return int(np.frombuffer(deltas, np.int8)[:prefix].sum(dtype=np.int64))


def truncate(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def prefix_counts(docs: DataFrame, model: str, limit: int = 4096, store: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_at and, unless ``store`` is false, the prefix deltas of every text (a byte for each code point).

    ``cut_at``: code points of the longest prefix of at most ``limit`` tokens.  No shuffle.
    """
    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_at long" + ", deltas binary" * store

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = PrefixCounter(model)
        counter, schema = _counters[model], arrow_ddl(ddl)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    deltas = counter.prefix_deltas(text or "")
                    total, raw = int(deltas.sum(dtype=np.int64)), deltas.tobytes()
                    cut = len(deltas) if total <= limit else truncate(raw, limit)
                    row = (doc_id, len((text or "").encode()), total, total > limit, cut)
                    rows.append((*row, raw) if store else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidied(count), ddl)
