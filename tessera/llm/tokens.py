"""Token ids of whole texts with a public tokenizer file, cut at white space and memoised.

Both vocabularies in use never build a token across "non-space, then white
space": such a place can be cut and the two sides encoded apart with the same
ids. Words repeat, so the ids of each distinct cut are asked of the tokenizers
library once per worker and kept in a bounded memo.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from tessera.llm import words as W

# Non-space as the tokenizers see it: Python's \s also takes the four separators 1C-1F.
_NS = r"[\S\x1c-\x1f]"
# Letters that end before full stops, commas or exclamation marks which end the word:
# both vocabularies keep letters and these marks apart, so more cuts are equal.
_CUT = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]++(?=[.,!]+(?:[ \n]|\Z))"
# A word that drops its white space (word vocabulary).
WORDS = re.compile(rf"{_CUT}|{_NS}+")
# A word with the blanks and newlines before it; white space at the end; or, from
# the first other white space on, the rest of the text in one piece (byte vocabulary).
PIECES = re.compile(rf"[ \n]*(?:{_CUT}|{_NS}+)|\s+\Z|\s(?s:.*)")
LONG = 48          # longer pieces are encoded but not kept
MEMO = 1_500_000   # pieces kept by one worker
_SPACE = set(" \n\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(x) for x in range(0x2000, 0x200B)}


class Encoder:
    """``ids(texts) -> (flat uint32 ids, ids per text)`` for one tokenizer file.

    A null text has no ids. Special-token strings in a text are ordinary text.
    """

    def __init__(self, path: str, pattern: re.Pattern):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.find = pattern.findall
        # The word vocabulary drops white space and marks word ends; the byte vocabulary does neither.
        self.sep = " " if pattern is WORDS else ""
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)   # bytes of text an id stands for
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token.removesuffix("</w>") if self.sep else token)
        self._reset()

    def _reset(self):
        self.memo: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)   # first[i]:first[i + 1] are the ids of piece i
        self.n = 0

    def _spans(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with white space or a dropped blank, encoded as a
        few long texts; each id's length in bytes tells which piece it belongs to."""
        ids, sizes = [], []
        for i in range(0, len(pieces), 4096):
            some = pieces[i: i + 4096]
            text = self.sep.join(some)
            ids.append(np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64))
            if self.sep:
                some = self.tok.normalizer.normalize_str(text).split(self.sep)
            sizes.append(np.fromiter((len(p.encode()) for p in some), np.int64, len(some)))
        flat, sizes = np.concatenate(ids), np.concatenate(sizes)
        if len(sizes) != len(pieces) or sizes.sum() != self.width[flat].sum():
            raise ValueError("the vocabulary does not cover these texts byte by byte")
        upto = np.cumsum(self.width[flat])
        return flat.astype(np.uint32), np.diff(np.searchsorted(upto, np.cumsum(sizes), side="right"), prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        alone = [] if self.sep else [p for p in pieces if p[0] not in " \n" or p[-1] in _SPACE]
        joined = pieces if self.sep else [p for p in pieces if p[0] in " \n" and p[-1] not in _SPACE]
        got = [e.ids for e in self.tok.encode_batch_fast(alone, add_special_tokens=False)]
        flat = np.fromiter((x for g in got for x in g), np.uint32)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        if joined:
            more, more_lens = self._spans(joined)
            flat, lens = np.concatenate([flat, more]), np.concatenate([lens, more_lens])
        n, at, pieces = self.n, int(self.first[self.n]), alone + joined
        while n + len(pieces) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.first[n + 1: n + 1 + len(pieces)] = at + np.cumsum(lens)
        self.flat[at: at + len(flat)] = flat
        self.memo.update(zip(pieces, range(n, n + len(pieces))))
        self.n += len(pieces)

    def _folded(self, text: str) -> str:
        """Lower case where the vocabulary lowers anyway and the rule is the same (Latin-1 texts)."""
        if self.sep:
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return text

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > MEMO:
            self._reset()
        per_text = [self.find(self._folded(t)) if t else [] for t in texts]
        pieces = [p for ps in per_text for p in ps]
        found = list(map(self.memo.get, pieces))
        new = {p for p, i in zip(pieces, found) if i is None} if None in found else ()
        if new:
            self._learn(list(new))
            found = [self.memo[p] if i is None else i for p, i in zip(pieces, found)]
        which = np.array(found, np.int64)
        begin, lens = self.first[which], self.first[which + 1] - self.first[which]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(begin - (ends - lens), lens) + np.arange(total)]
        counts = np.zeros(len(texts), np.int64)
        n_pieces = np.fromiter(map(len, per_text), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(n_pieces)])
        upto = np.concatenate([[0], ends])
        counts[:] = upto[bounds[1:]] - upto[bounds[:-1]]
        for p in [p for p in new if len(p) > LONG]:
            self.memo.pop(p)
        return flat, counts


_MARKS = np.zeros(256, bool)
_MARKS[[ord("."), ord(","), ord("!")]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_SPACE = {x.encode() for x in _SPACE if ord(x) > 127}
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)     # odd multipliers


def word_pieces(texts: pa.LargeStringArray) -> W.Words:
    """The pieces that ``WORDS`` finds in each text, as byte ranges, A-Z lower-cased: runs without white space, and
    full stops, commas and exclamation marks at the end of a run of letters apart from it."""
    buf, offsets = W.raw(texts)
    buf = W._LOWER[buf]
    blank = _BLANK[buf]
    for i in np.flatnonzero(_WIDE_LEAD[buf]).tolist() if _WIDE_LEAD[buf].any() else ():
        for n in (2, 3):
            if buf[i:i + n].tobytes() in _WIDE_SPACE:
                blank[i:i + n] = True
    n, solid = len(buf), ~blank
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = solid[cuts]
    end[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    letter = _LETTER[buf]
    two = np.flatnonzero(buf[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
    two = two[(buf[two + 1] != 0x97) & (buf[two + 1] != 0xB7)]            # all of C3 but the two signs
    letter[two] = letter[two + 1] = True
    other = np.concatenate([[0], np.cumsum(~letter)])
    marks = np.flatnonzero(_MARKS[buf[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
    before = np.maximum.accumulate(np.where(_MARKS[buf], -1, np.arange(n)))       # the last byte that is no mark
    split = before[ends[marks] - 1] + 1 if len(marks) else np.zeros(0, np.int64)
    fits = (split > starts[marks]) & (other[np.maximum(split, 0)] == other[starts[marks]])
    split = split[fits]
    starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    first = np.searchsorted(starts, offsets)
    return W.Words(buf, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def _two_hashes(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece's bytes."""
    lens = w.ends - w.starts
    firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum())) - np.repeat(firsts, lens)
    data = w.buf[pos + np.repeat(w.starts, lens)].astype(np.uint64) + np.uint64(1)
    out = []
    for step in (_A, _B):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lens.max()), step)]))
        out.append(W.mix(np.add.reduceat(data * powers[pos], firsts) + lens.astype(np.uint64)))
    return out[0], out[1]


class WordEncoder(Encoder):
    """The same ids for the word vocabulary from Arrow texts: equal pieces of a batch are found by hash in arrays, and
    only those not met before become strings. Pieces count as equal where 128 bits of hashes agree."""

    KEPT_IDS = 1 << 25

    def __init__(self, path: str):
        super().__init__(path, WORDS)

    def _reset(self):
        super()._reset()
        self.place: dict[int, int] = {}             # first hash of a piece -> its number
        self.check = np.zeros(1 << 14, np.uint64)   # its second hash

    def ids_of(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        if self.n > MEMO or int(self.first[self.n]) > self.KEPT_IDS:
            self._reset()
        w = word_pieces(texts)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        one, two = _two_hashes(w)
        kinds, at, which = np.unique(one, return_index=True, return_inverse=True)
        second = two[at]
        found = np.fromiter(map(self.place.get, kinds.tolist(), repeat(-1)), np.int64, len(kinds))
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, start = w.buf.tobytes(), self.n
            self._learn([raw[a:b].decode() for a, b in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist())])
            self.memo.clear()
            found[new] = np.arange(start, self.n)
            while self.n > len(self.check):
                self.check = np.concatenate([self.check, np.zeros_like(self.check)])
            self.check[start:self.n] = second[new]
            self.place.update(zip(kinds[new].tolist(), range(start, self.n)))
        if (self.check[found] != second).any() or (two != second[which]).any():
            # Two pieces share a hash: a fresh table, and these texts as strings.
            self._reset()
            out = self.ids(texts.to_pylist())
            self._reset()
            return out
        piece = found[which]
        begin, lens = self.first[piece], self.first[piece + 1] - self.first[piece]
        ends = np.cumsum(lens)
        flat = self.flat[np.repeat(begin - (ends - lens), lens) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])
        return flat, upto[w.first[1:]] - upto[w.first[:-1]]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: re.Pattern) -> Encoder:
    """The worker's encoder of this file (kept between tasks)."""
    key = (path, pattern.pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


_word_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of this word vocabulary (kept between tasks)."""
    if path not in _word_encoders:
        _word_encoders[path] = WordEncoder(path)
    return _word_encoders[path]
