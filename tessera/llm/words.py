"""Words of Arrow text columns as numpy arrays over the UTF-8 bytes.

A word is a maximal run of bytes outside 20 and 09-0D, never across two texts.
Whole texts are read, a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20          # texts are worked through in slices of about this many bytes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd multipliers of the polynomial word hash.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Words:
    """Word k is ``buf[starts[k]:ends[k]]`` of row ``row[k]``; ``first[i]`` is row i's
    first word, ``first[-1]`` the number of words."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """(first row, texts) pieces of about ``size`` bytes; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a slice."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(texts: pa.LargeStringArray) -> Words:
    """Words of a slice, A-Z lower-cased."""
    buf, offsets = raw(texts)
    buf = _LOWER[buf]
    solid = ~_SPACE[buf]
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
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, starts, ends, row, first)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    lens = w.ends - w.starts
    firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum())) - np.repeat(firsts, lens)
    data = w.buf[pos + np.repeat(w.starts, lens)].astype(np.uint64) + np.uint64(1)
    low = np.power(_P, np.arange(min(int(lens.max()), 1 << 12), dtype=np.uint64))
    high = np.power(_Q, np.arange((int(lens.max()) >> 12) + 1, dtype=np.uint64))
    data *= low[pos & 0xFFF]
    if len(high) > 1:
        data *= high[pos >> 12]
    return mix(np.add.reduceat(data, firsts) + lens.astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, row) of each run of ``size`` words of one row; a row with
    fewer words, but at least one, gives one shorter run."""
    n_words = np.diff(first)
    runs = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n_words)), runs)
    upto = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(int(upto[-1])) - upto[:-1][row] + first[:-1][row]
    out = np.zeros(len(at), np.uint64)
    last = first[1:][row]
    for k in range(size):
        inside = at + k < last
        out = np.where(inside, (out + h[np.minimum(at + k, max(len(h) - 1, 0))]) * _P if len(h) else out, out)
    return mix(out), at, row
