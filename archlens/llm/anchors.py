"""Runs of windows that share an anchor: how repeated windows find each other.

Symbols are words or bytes.  Of the grams of ``gram`` symbols inside a window of
``window`` symbols, the one with the least hash (the first of equals) is the
window's anchor, so equal windows have equal anchors at the same place.  Windows
next to each other mostly share an anchor; such a run is one row, about two for
every ``window - gram`` symbols, instead of one row for every window.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from archlens.llm.common import gram_hashes


class Runs(NamedTuple):
    """Arrays with an entry for each run."""

    start: np.ndarray  # first symbol of the first window, counted through all documents
    count: np.ndarray  # windows
    place: np.ndarray  # anchor less start
    key: np.ndarray  # hash of the anchor's gram


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the index of its first least value."""
    best, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = size if 2 * size <= width else width - size
        right = best[step:] < best[:-step]
        best = np.where(right, best[step:], best[:-step])
        at = np.where(right, at[step:], at[:-step])
        size += step
    return at


def runs(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Runs:
    """The runs of all documents; document i has the symbols offsets[i] to offsets[i + 1]."""
    n = len(values)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    valid = np.flatnonzero(room[: max(0, n - window + 1)] >= window)
    if not len(valid):
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)))
    grams = gram_hashes(values, gram)
    anchor = window_argmin((grams >> np.uint64(32)).astype(np.uint32), window - gram + 1)[valid]
    # a run's windows follow each other: none leads over the end of a document
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(valid)]]) - 1
    start, anchor = valid[first], anchor[first].astype(np.int64)
    return Runs(start, last - first + 1, anchor - start, grams[anchor])
