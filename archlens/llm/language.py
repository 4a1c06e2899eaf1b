"""Language identification by bit-sliced Bloom filters of n-grams.

Grams are three bytes of the text, ASCII letters lowered and everything that is
no letter made one space, so there are 2**24 of them at most.  One array of cells holds
the Bloom filters of all languages, a bit of a cell for each language and level: the AND
of a gram's cells is the set of all languages that contain it and, for each, the levels of
frequency that it reaches there.  Nothing is left out: a gram seen once in a language is
in its first level.  Per-language popcounts over a text's grams, each level corrected for
its filter's known rate of false positives, decide; the levels weigh a language's own
grams above strays, as mixed and mislabelled texts bring any gram into any language.

Counts come from all labelled training rows, with one partial sum for each task; the
cells are filled by Spark, and only they reach the driver, MOST_CELLS at most.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go
to the first language in order; without training rows every text is ``und``; a row without
a doc_id is predicted, not held out and not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import arrow_ddl, mix, saved, slices, tidied, utf8

#: Least share of a language's grams at each level; the first holds every gram.
LEVELS = (0.0, 1e-5, 1e-4, 1e-3)
#: Cells of the filter for each gram of the largest language, hash functions, and a bound on the cells (beyond it, false positives rise, and the correction with them).
CELLS_PER_GRAM, HASHES, MOST_CELLS = 8, 4, 1 << 22

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Filter(NamedTuple):
    """Languages, the cells (words of bits, bit ``language * levels + level``) and the rate of false positives of each bit."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes of all rows and the row of each code."""
    lengths = np.diff(offsets)
    # a space before and behind every text
    at = np.arange(len(data)) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)
    folded = np.full(len(data) + 2 * len(lengths), 32, np.uint8)
    folded[at] = _FOLD[data]
    row = np.repeat(np.arange(len(lengths)), lengths + 2)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (row[1:] != row[:-1])
    folded, row = folded[keep].astype(np.int64), row[keep]
    codes = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    inside = row[:-2] == row[2:]
    return codes[inside], row[:-2][inside]


def training(doc_id: Column, modulus: int = 4, held: int = 2) -> Column:
    """Whether a row is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != held


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, count) of labelled rows."""
    ddl = "lang string, gram long, count long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge() -> None:
            for lang, parts in held.items():
                if len(parts) > 1:
                    codes, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    held[lang] = [(codes, np.bincount(index, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for batch in batches:
            for part in slices(batch):
                codes, row = grams(*utf8(part.column("text")))
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                number = {x: i for i, x in enumerate(names)}
                of = np.array([number[x] for x in langs])[row]
                for i, name in enumerate(names):
                    held.setdefault(name, []).append(np.unique(codes[of == i], return_counts=True))
                size += 1
                if size % 64 == 0:
                    merge()
        merge()
        for lang, parts in held.items():
            codes, counts = parts[0]
            for a in range(0, len(codes), 50_000):
                part = codes[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(counts[a : a + 50_000])], schema=arrow_ddl(ddl))

    return docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(tidied(count), ddl).groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def cells_of(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The cell of each code under each hash function; ``size`` is a power of two."""
    h = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def learn(docs: DataFrame, levels: Sequence[float] = LEVELS) -> Filter:
    """The filter learned from the rows of ``docs`` (text, lang)."""
    counts = saved(gram_counts(docs), "gram_counts", narrow=True)
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"), F.count("*").alias("grams")).collect()  # a row for each language
    languages = sorted(r["lang"] for r in totals)
    largest = max((r["grams"] for r in totals), default=1)
    size = min(MOST_CELLS, 1 << max(10, (CELLS_PER_GRAM * largest - 1).bit_length()))
    total = {r["lang"]: r["total"] for r in totals}
    first = {lang: i * len(levels) for i, lang in enumerate(languages)}
    words = max(1, -(-len(languages) * len(levels) // 64))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((words, size), np.uint64)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            codes, count = batch.column("gram").to_numpy(), batch.column("count").to_numpy()
            for lang in set(langs):
                mine = langs == lang
                share = count[mine] / total[lang]
                for level, least in enumerate(levels):
                    word, bit = divmod(first[lang] + level, 64)
                    for at in cells_of(codes[mine][share >= least], size):
                        cells[word, at] |= np.uint64(1 << bit)
        for word in range(words):
            used = np.flatnonzero(cells[word])
            for a in range(0, len(used), 100_000):
                at = used[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), word, np.int32)), pa.array(at), pa.array(cells[word, at].view(np.int64))], schema=arrow_ddl(_CELLS))

    found = counts.mapInArrow(tidied(fill), _CELLS).groupBy("word", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros((words, size), np.uint64)
    cells[found.column("word").to_numpy(), found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    bits = [divmod(i, 64) for i in range(len(languages) * len(levels))]
    rate = np.array([((cells[w] >> np.uint64(b)) & np.uint64(1)).mean() ** HASHES for w, b in bits])
    return Filter(languages, cells, rate)


_CELLS = "word int, cell long, bits long"


def sets(f: Filter, codes: np.ndarray) -> np.ndarray:
    """(words, grams): the bits of all languages and levels that contain each gram."""
    at = list(cells_of(codes, f.cells.shape[1]))
    out = f.cells[:, at[0]]
    for x in at[1:]:
        out &= f.cells[:, x]
    return out


def shares(f: Filter, codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Each row's grams in each language: the corrected share of every level, averaged."""
    found = sets(f, codes)
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    levels = len(f.false_rate) // len(f.languages)
    out = np.zeros((rows, len(f.languages)))
    for i, rate in enumerate(f.false_rate):
        word, bit = divmod(i, 64)
        hits = np.bincount(row[(found[word] & np.uint64(1 << bit)) > 0], minlength=rows)
        if rate < 1:
            out[:, i // levels] += np.clip((hits / n - rate) / (1 - rate), 0, 1) / levels
    return out


def predict(docs: DataFrame, f: Filter, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of all rows; with ``keep``, these columns of ``docs`` and the last two."""
    shared = docs.sparkSession.sparkContext.broadcast(f)
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"rename the columns {sorted(clash)} before keeping them")
    if keep:
        rows = docs.select(*keep)
        names = list(keep)
    else:
        rows = docs.select("doc_id", F.coalesce(~training(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
        names = ["doc_id", "held_out"]
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "lang_pred string, score double"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                found = shares(f, *grams(data, offsets), part.num_rows) if f.languages else np.zeros((part.num_rows, 1))
                best = found.argmax(axis=1)
                ascii_letter = np.zeros(len(data) + 1, np.int64)
                np.cumsum((_FOLD[data] >= 97) & (_FOLD[data] < 123), out=ascii_letter[1:])
                lettered = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py() or ""))
                known = lettered & bool(f.languages)
                labels = pa.array([f.languages[b] if k else "und" for b, k in zip(best, known)], pa.string())
                score = pa.array(np.where(known, found[np.arange(len(best)), best], 0.0))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), labels, score], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(tidied(decide), ddl)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and predict all rows."""
    return predict(docs, learn(docs.where(training(F.col("doc_id")))))
