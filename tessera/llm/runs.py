"""Runs of bytes of one class in Arrow text columns, and runs of consecutive words.

Shared by the operators whose words are not the blank-separated ones of ``words``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm import words as W


def table(outside: bytes) -> np.ndarray:
    """Which byte values belong to a word: all but ``outside``."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


def runs(texts: pa.LargeStringArray, inside: np.ndarray) -> W.Words:
    """Maximal runs of bytes with ``inside[byte]``, A-Z lower-cased first, never across two texts."""
    buf, offsets = W.raw(texts)
    buf = W._LOWER[buf]
    solid = inside[buf]
    n = len(buf)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = solid[cuts]
    end[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    return W.Words(buf, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def pieces(w: W.Words, breaks: np.ndarray) -> np.ndarray:
    """Piece number of each word: a new one at every text and after every byte with ``breaks[byte]``."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(breaks[w.buf], dtype=np.int64)])[w.starts]
    new = np.ones(len(w.starts), bool)
    new[1:] = (upto[1:] != upto[:-1]) | (w.row[1:] != w.row[:-1])
    return np.cumsum(new)
