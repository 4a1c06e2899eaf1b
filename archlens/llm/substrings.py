"""Substring deduplication by suffix automata of reference shards, on words.

The reference of a shard is a set of runs of windows (``repeats``), all runs of a key
together, each distinct one once with the number of its copies; the suffix automaton of
a key knows, for every state, how often the state's strings occur.  The runs are then
streamed through the automaton: the matching statistics give, at every word, the
longest match that ends there, and a window is repeated when the state of its length
occurs more than once.  Maximal spans of repeated windows are removed.

The automata are built in the tasks to which Spark sends the runs of a shard.
Sending every automaton to every document instead would cost the product of both.

Defined results: a null or empty text has no words; rows that repeat a text are
repeats of each other; a row without a doc_id is treated like any other and keeps its null; texts are judged on the input; extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import arrow_ddl, slices, tidied, utf8, word_bounds
from archlens.llm.repeats import Segment, Unit, covered, digest, identified, removal_mask, repeated_runs

#: Words of a window, and of the grams that anchor it.
WINDOW, GRAM = 35, 10


class SuffixAutomaton:
    """All substrings of sequences of symbols, with the number of times each occurs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.times = [0]

    def _state(self, length: int, link: int, moves: dict, times: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.times.append(times)
        return len(self.link) - 1

    def _split(self, at: int, symbol: object, target: int) -> int:
        """A copy of ``target`` for the strings of length[at] + 1 symbols and less."""
        copy = self._state(self.length[at] + 1, self.link[target], self.next[target].copy(), 0)
        self.link[target] = copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: list, times: int = 1) -> None:
        """Add a sequence that occurs ``times`` times."""
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
            else:
                new, at = self._state(self.length[last] + 1, 0, {}, 0), last
                while at >= 0 and symbol not in self.next[at]:
                    self.next[at][symbol] = new
                    at = self.link[at]
                if at >= 0:
                    target = self.next[at][symbol]
                    self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
                last = new
            self.times[last] += times

    def close(self) -> None:
        """Add up occurrences; call it once, after the last sequence."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.times[self.link[state]] += self.times[state]

    def statistics(self, sequence: list) -> Iterator[tuple[int, int]]:
        """At every symbol: the length of the longest match that ends there, and its state."""
        state = length = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield length, state

    def repeated(self, sequence: list, window: int) -> np.ndarray:
        """Which windows of the sequence occur more than once in what was added."""
        out = np.zeros(max(0, len(sequence) - window + 1), bool)
        for end, (length, state) in enumerate(self.statistics(sequence), 1):
            if length >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                out[end - window] = self.times[state] > 1
        return out


def resolve(segments: list[Segment], unit: Unit) -> list[np.ndarray]:
    """The repeated windows of each segment, by one automaton for each key of the shard."""
    out: list[np.ndarray] = [np.ones(0, bool)] * len(segments)
    by_key: dict[int, list[int]] = {}
    for i, s in enumerate(segments):
        by_key.setdefault(s.key, []).append(i)
    for members in by_key.values():
        automaton = SuffixAutomaton()
        sequences = {i: segments[i].text.split(b" ") for i in members}
        for i, words in sequences.items():
            automaton.add(words, segments[i].copies)
        automaton.close()
        for i, words in sequences.items():
            out[i] = automaton.repeated(words, unit.window)
    return out


_OUT = "n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_removed, n_spans, kept_sha256, kept_text and the columns ``keep``.

    kept_sha256 is that of the kept words joined by one space; kept_text is the text
    without the removed words and the white space behind them.
    """
    unit = Unit(True, window, gram)
    joined = covered(repeated_runs(identified(docs), unit, resolve), identified(docs, keep))
    kinds = dict(docs.dtypes)
    if clash := {x.split()[0] for x in _OUT.split(", ")} & set(keep):
        raise ValueError(f"rename the columns {sorted(clash)} before keeping them")
    ddl = ", ".join(["doc_id long", "named boolean", *(f"`{c}` {kinds[c]}" for c in keep), _OUT])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_ddl(_OUT)
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                starts, _, bounds = word_bounds(data, offsets)
                raw, out = data.tobytes(), []
                lists = (part.column(c).to_pylist() for c in ("starts", "windows", "flags"))
                for row, (first, windows, flags) in enumerate(zip(*lists)):
                    text = raw[offsets[row] : offsets[row + 1]]
                    words = text.split()
                    gone = removal_mask(len(words), first, windows, flags, window)
                    removed, kept_text = int(gone.sum()), text
                    if removed:
                        words = list(compress(words, ~gone))
                        cuts = np.concatenate([starts[bounds[row] : bounds[row + 1]] - offsets[row], [len(text)]])
                        head = text[: cuts[0]]
                        kept_text = head + b"".join([text[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(~gone)])
                    spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
                    out.append((len(gone), removed, spans, digest(b" ".join(words)), kept_text.decode()))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                names = ["doc_id", "named", *keep, *schema.names]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[: len(keep) + 2]), *columns], names=names)

    return joined.mapInArrow(tidied(cut), ddl).withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")
