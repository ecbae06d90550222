"""Adaptive context-mixing range coder for blocks of token ids, many blocks in lockstep.

Each block stands alone: its header has the sorted ids it uses, and every
statistic starts anew. Three predictors drive one arithmetic-coding step per id:
order 2 and order 1 each propose the id last seen after the last two ids, or the
last one, and order 0 has adaptive frequencies of the block's ids. The share of
probability that goes to a proposal is learned from how often proposals of that
confidence came true in this block. All state is integer, so the reader's
predictions equal the writer's.

Blocks are coded side by side, one id of each per step, with numpy.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BLOCK = 8192               # ids of a block, at most
LANES = 512                # blocks coded side by side, at most
MAGIC = b"TID1"
_HEAD = struct.Struct("<4sIIIII")
_SHARE = 12                # bits of a mixing weight
_REFRESH = 256             # ids between two renewals of the order-0 table
_SLOTS = 1 << 13           # order-2 contexts of a block
_TOP, _LOW = np.uint64(1 << 56), np.uint64(1 << 40)
_16, _40 = np.uint64(16), np.uint64(40)
_MASK56, _MASK40, _MASK16 = _TOP - np.uint64(1), _LOW - np.uint64(1), np.uint64(0xFFFF)


class _Model:
    """Predictions for ``lanes`` blocks with these numbers of symbols."""

    def __init__(self, symbols: np.ndarray):
        n, width = len(symbols), int(symbols.max())
        lanes = np.arange(n, dtype=np.int32)
        self.width = width
        self.count = (np.arange(width)[None, :] < symbols[:, None]).astype(np.int32)
        self.flat_count = self.count.reshape(-1)
        self.at0 = lanes * np.int32(width)
        # Running totals, padded to a power of two for the search.
        self.reach = 1 << width.bit_length()
        self.cum = np.full((n, self.reach), np.iinfo(np.int32).max, np.int32)
        self.cum[:, 0] = 0
        self.flat_cum = self.cum.reshape(-1)
        self.at_cum = lanes * np.int32(self.reach)
        # A context's entry is the proposed symbol * 4 + confidence.
        self.one = np.zeros(n * width, np.int32)
        self.two = np.zeros(n * _SLOTS, np.int32)
        self.at2 = lanes * np.int32(_SLOTS)
        self.hit1 = np.full(n * 4, 1 << _SHARE - 4, np.int32)
        self.hit2 = np.full(n * 4, 1 << _SHARE - 4, np.int32)
        self.at4 = lanes * np.int32(4)
        self.last = np.zeros(n, np.int32)
        self.before = np.zeros(n, np.int32)
        self.step = 0

    def predict(self) -> None:
        """Sets proposals, weights and the order-0 table for the next symbol."""
        if self.step % _REFRESH == 0:
            np.cumsum(self.count, axis=1, out=self.cum[:, 1:self.width + 1])
            self.total = self.cum[:, self.width].copy()
            self.scale = self.total.astype(np.uint64) << np.uint64(_SHARE)
        self.step += 1
        self.i1 = self.at0 + self.last
        self.i2 = self.at2 + ((self.before * np.int32(24_593) + self.last * np.int32(12_289)) >> np.int32(3) & np.int32(_SLOTS - 1))
        e1, e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.c1, self.c2 = e1 >> 2, e2 >> 2
        self.s1, self.s2 = e1 & 3, e2 & 3
        self.j1, self.j2 = self.at4 + self.s1, self.at4 + self.s2
        self.p1, self.p2 = self.hit1.take(self.j1), self.hit2.take(self.j2)
        w2 = self.p2
        w1 = (np.int32(1 << _SHARE) - w2) * self.p1 >> np.int32(_SHARE)
        self.w0 = np.int32(1 << _SHARE) - w1 - w2
        self.t1, self.t2 = self.total * w1, self.total * w2

    def interval(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, size) of a symbol in the mixed distribution."""
        i = self.at_cum + sym
        low0 = self.flat_cum.take(i)
        low = self.w0 * low0 + self.t2 * (self.c2 < sym) + self.t1 * (self.c1 < sym)
        size = self.w0 * (self.flat_cum.take(i + 1) - low0) + self.t2 * (self.c2 == sym) + self.t1 * (self.c1 == sym)
        return low, size

    def symbol(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol whose interval holds t, and that interval."""
        lo2, n2 = self.interval(self.c2)
        lo1, n1 = self.interval(self.c1)
        past2, past1 = t >= lo2 + n2, t >= lo1 + n1
        rest = (t - self.t2 * past2 - self.t1 * past1) // self.w0
        at, half = self.at_cum.copy(), self.reach >> 1
        while half:                                    # the last running total that is at most rest
            at += (self.flat_cum.take(at + np.int32(half)) <= rest) * np.int32(half)
            half >>= 1
        sym = at - self.at_cum
        sym = np.where((t >= lo2) & ~past2, self.c2, sym)
        sym = np.where((t >= lo1) & ~past1, self.c1, sym)
        return sym, *self.interval(sym)

    def update(self, sym: np.ndarray) -> None:
        self.flat_count[self.at0 + sym] += 1
        for hits, j, p, entries, i, c, s in ((self.hit1, self.j1, self.p1, self.one, self.i1, self.c1, self.s1),
                                             (self.hit2, self.j2, self.p2, self.two, self.i2, self.c2, self.s2)):
            right = c == sym
            hits[j] = p + ((right * np.int32(3900) - p) >> 4) + (p < 16)
            kept = (c << 2) + np.where(right, np.minimum(s + 1, 3), s - 1)
            entries[i] = np.where(right | (s > 0), kept, sym << 2)
        self.before, self.last = self.last, sym

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        for name in ("at0", "at_cum", "at2", "at4", "last", "before", "total", "scale"):
            if hasattr(self, name):
                setattr(self, name, getattr(self, name)[:n])
        self.count, self.cum = self.count[:n], self.cum[:n]


def _order(lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Lanes by falling length, and (first step, end step, lanes) stretches."""
    order = np.argsort(-lengths, kind="stable")
    out, at = [], 0
    for end in sorted(set(lengths.tolist())):
        out.append((at, end, int((lengths >= end).sum())))
        at = end
    return order, [x for x in out if x[1] > x[0]]


def _encode(symbols: np.ndarray, lengths: np.ndarray, matrix: np.ndarray) -> list[np.ndarray]:
    """Code words (16 bits) of each row of ``matrix``; rows by falling length."""
    n, most = matrix.shape
    model, cap = _Model(symbols), 2 * most + 16
    out = np.zeros(n * cap, np.uint32)
    pos = np.arange(n) * cap
    low, size = np.zeros(n, np.uint64), np.full(n, _TOP)
    columns = np.ascontiguousarray(matrix.T.astype(np.int32))

    def carried(lanes: np.ndarray) -> None:
        at = pos[lanes] - 1
        while len(at):
            out[at] += 1
            at = at[out[at] > 0xFFFF]
            out[at] = 0
            at = at - 1

    def emit(lanes: np.ndarray) -> None:
        out[pos[lanes]] = (low[lanes] >> _40).astype(np.uint32)
        pos[lanes] += 1
        low[lanes] = (low[lanes] & _MASK40) << _16

    for first, end, k in _order(lengths)[1]:
        model.shrink(k)
        for t in range(first, end):
            model.predict()
            sym = columns[t, :k]
            lo, width = model.interval(sym)
            unit = size[:k] // model.scale
            now = low[:k] + unit * lo.astype(np.uint64)
            over = now >= _TOP
            low[:k] = now & _MASK56
            if over.any():
                carried(np.flatnonzero(over))
            size[:k] = unit * width.astype(np.uint64)
            for _ in range(2):
                small = np.flatnonzero(size[:k] < _LOW)
                if not len(small):
                    break
                emit(small)
                size[small] <<= _16
            model.update(sym)
    for _ in range(4):
        emit(np.arange(n))
    return [out[i * cap: pos[i]].astype("<u2") for i in range(n)]


def _decode(symbols: np.ndarray, lengths: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """Symbols of each row (rows by falling length), a row a block."""
    n, most = len(codes), int(lengths.max())
    model = _Model(symbols)
    cap = max(map(len, codes)) + 8
    data = np.zeros(n * cap, np.uint64)
    for i, c in enumerate(codes):
        data[i * cap: i * cap + len(c)] = c
    pos = np.arange(n) * cap
    code, size = np.zeros(n, np.uint64), np.full(n, _TOP)
    for _ in range(3):
        code = (code << _16) | data[pos]
        pos += 1
    code = (code << np.uint64(8)) | (data[pos] >> np.uint64(8))     # 56 bits; the other 8 wait
    wait = data[pos] & np.uint64(0xFF)
    pos += 1
    out = np.zeros((most, n), np.int64)
    for first, end, k in _order(lengths)[1]:
        model.shrink(k)
        for t in range(first, end):
            model.predict()
            unit = size[:k] // model.scale
            point = np.minimum(code[:k] // unit, model.scale - np.uint64(1)).astype(np.int32)
            sym, lo, width = model.symbol(point)
            code[:k] -= unit * lo.astype(np.uint64)
            size[:k] = unit * width.astype(np.uint64)
            for _ in range(2):
                small = np.flatnonzero(size[:k] < _LOW)
                if not len(small):
                    break
                more = data[pos[small]]
                code[small] = (code[small] << _16) | (wait[small] << np.uint64(8)) | (more >> np.uint64(8))
                wait[small] = more & np.uint64(0xFF)
                pos[small] += 1
                size[small] <<= _16
            model.update(sym)
            out[t, :k] = sym
    return out


def encode_blocks(blocks: list[np.ndarray], notes: list[bytes] | None = None) -> list[bytes]:
    """One self-contained byte string for each block of 1 to BLOCK ids (uint32);
    ``notes`` are bytes kept with each block."""
    if any(not 0 < len(b) <= BLOCK for b in blocks):
        raise ValueError(f"a block has 1 to {BLOCK} ids")
    done: list[bytes] = [b""] * len(blocks)
    for lo in range(0, len(blocks), LANES):
        some = blocks[lo: lo + LANES]
        lengths = np.array([len(b) for b in some])
        order, _ = _order(lengths)
        alphabets = [np.unique(b, return_inverse=True) for b in some]
        matrix = np.zeros((len(some), int(lengths.max())), np.int64)
        for k, i in enumerate(order):
            matrix[k, :lengths[i]] = alphabets[i][1]
        symbols = np.array([len(alphabets[i][0]) for i in order])
        codes = _encode(symbols, lengths[order], matrix)
        for k, i in enumerate(order):
            ids = np.ascontiguousarray(some[i], "<u4")
            alphabet = zlib.compress(np.diff(alphabets[i][0].astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes())
            note = notes[lo + i] if notes else b""
            head = _HEAD.pack(MAGIC, len(ids), len(alphabet), len(note), len(codes[k]), zlib.crc32(ids.tobytes()))
            done[lo + i] = head + alphabet + note + codes[k].tobytes()
    return done


@dataclass
class Block:
    ids: np.ndarray
    note: bytes


def decode_blocks(data: list[bytes]) -> list[Block]:
    """The blocks; a wrong mark, length or checksum raises ValueError."""
    out: list[Block | None] = [None] * len(data)
    for lo in range(0, len(data), LANES):
        parts = []
        for raw in data[lo: lo + LANES]:
            try:
                magic, n, n_alphabet, n_note, n_code, crc = _HEAD.unpack_from(raw)
                at = _HEAD.size
                if magic != MAGIC or len(raw) != at + n_alphabet + n_note + 2 * n_code or not 0 < n <= BLOCK:
                    raise ValueError("not a whole block")
                alphabet = np.cumsum(np.frombuffer(zlib.decompress(raw[at: at + n_alphabet]), "<u4"), dtype=np.uint32)
            except (struct.error, zlib.error) as e:
                raise ValueError("not a whole block") from e
            at += n_alphabet
            parts.append((n, alphabet, raw[at: at + n_note], np.frombuffer(raw, "<u2", n_code, at + n_note), crc))
        lengths = np.array([p[0] for p in parts])
        order, _ = _order(lengths)
        rows = _decode(np.array([len(parts[i][1]) for i in order]), lengths[order], [parts[i][3] for i in order])
        for k, i in enumerate(order):
            n, alphabet, note, _, crc = parts[i]
            sym = rows[:n, k]
            if sym.max() >= len(alphabet):
                raise ValueError("a block is damaged")
            ids = alphabet[sym].astype("<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("a block's checksum is wrong")
            out[lo + i] = Block(ids, note)
    return out
