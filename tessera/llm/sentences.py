"""Substring dedup by sliding sentence spans.

A sentence is a run of words up to one that ends in . ! or ?, or up to a line's
end. From every sentence on, and back from every sentence, the shortest run of at
least SENTENCES sentences with at least WORDS words is hashed (a sentence of LONE
words or more is a run of its own); once more with line ends left out, since copies may be wrapped anew.
Passages that hold too few whole sentences are found by spans: a word is a cut if it
has the least hash of any CUT words in a row, and from every cut on the words up to
the first cut PASSAGE words or more away are hashed, unless they hold a run of whole
sentences. Cuts depend on less than CUT words to either side, so any 51 words in a
row hold the same run or span wherever they occur. Equal runs are joined over the
whole corpus; a run is the first one if its document's id, text hash and place are
the least. A word covered by any run that is not the first of its kind is removed; a
span that overlaps the first of its kind is no repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.llm import words as W

SENTENCES, WORDS, LONE = 2, 12, 40
CUT, PASSAGE = 3, 42          # 4 CUT + PASSAGE - 3 <= 51
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STOPS = np.zeros(256, bool)
_STOPS[[ord("."), ord("!"), ord("?")]] = True


def sentence_bounds(w: W.Words, by_line: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence and the number of words at the end, row of each sentence)."""
    n = len(w.starts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    last = np.ones(n, bool)
    last[:-1] = _STOPS[w.buf[w.ends[:-1] - 1]] | (w.row[1:] != w.row[:-1])
    if by_line:
        lines = np.cumsum(w.buf == 10)
        last[:-1] |= lines[w.starts[1:]] != lines[w.ends[:-1] - 1]
    bounds = np.concatenate([[0], np.flatnonzero(last) + 1])
    return bounds, w.row[bounds[:-1]]


def cuts(h: np.ndarray, row: np.ndarray, size: int = CUT) -> np.ndarray:
    """Words with the least hash (the last of equals) of any ``size`` words in a row of one text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = h[:n].copy(), np.arange(n)
    for k in range(1, size):
        less = h[k: n + k] <= least
        least[less] = h[k: n + k][less]
        at[less] = np.flatnonzero(less) + k
    chosen = np.zeros(len(h), bool)
    chosen[at[row[:n] == row[size - 1:]]] = True
    return np.flatnonzero(chosen)


def _whole(w: W.Words, by_line: bool, sentences: int, words: int, lone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end) of the runs of whole sentences; then the bounds and the end of the run on from each sentence."""
    bounds, row = sentence_bounds(w, by_line)
    at = np.arange(len(row))
    of_row = np.searchsorted(row, np.arange(len(w.first)))       # first sentence of each row, and the end
    alone = np.diff(bounds) >= lone
    end = np.maximum(at + sentences, np.searchsorted(bounds, bounds[:-1] + words))
    end = np.where(alone, at + 1, end)
    begin = np.minimum(at + 1 - sentences, np.searchsorted(bounds, bounds[1:] - words, side="right") - 1)
    begin = np.where(alone, at, begin)
    on, back = end <= of_row[1:][row], begin >= of_row[:-1][row]
    return bounds[np.concatenate([at[on], begin[back]])], bounds[np.concatenate([end[on], at[back] + 1])], bounds, end


def runs(w: W.Words, sentences: int = SENTENCES, words: int = WORDS, lone: int = LONE, passage: int = PASSAGE
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word in its row, words) of every run that fits its row; a span's hash is odd, others' are even."""
    n = len(w.starts)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    h = W.hashes(w)
    a, b, _, _ = _whole(w, True, sentences, words, lone)
    a2, b2, bounds, end = _whole(w, False, sentences, words, lone)
    a, b = np.divmod(np.unique(np.concatenate([a, a2]) * (n + 1) + np.concatenate([b, b2])), n + 1)
    cut = cuts(h, w.row)
    to = np.searchsorted(cut, cut + passage)
    cut, to = cut[to < len(cut)], cut[to[to < len(cut)]]
    first = np.searchsorted(bounds, cut, side="right")           # sentences that begin and end inside
    holds = end[np.minimum(first, len(end) - 1)] < np.searchsorted(bounds, to, side="right")
    spans = (w.row[cut] == w.row[to]) & ~(holds & (first < len(end)))
    odd = np.repeat([0, 1], [len(a), int(spans.sum())]).astype(np.uint64)
    a, b = np.concatenate([a, cut[spans]]), np.concatenate([b, to[spans]])
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
    key = W.mix((upto[b] - upto[a]) * back[a] + (b - a).astype(np.uint64))
    return key & ~np.uint64(1) | odd, w.row[a], a - w.first[w.row[a]], b - a


def _later(key: np.ndarray, k: np.ndarray, h: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For rows sorted by key and identity: whether an equal key with a lesser identity comes
    before; not so for a span that overlaps it."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    other = (k != k[first]) | (h != h[first])
    return other | (pos != pos[first]) & ((key.astype(np.uint64) & np.uint64(1) == 0) | (pos >= pos[first] + n[first]))


_SPAN = "p long, later boolean, k long, h long, pos int, n int"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a batch; those that repeat a run of the same batch are known not to be the
    first, so that a run goes to its hash's partition once a batch at most."""
    for b in batches:
        k, h = np.asarray(b.column(0)), np.asarray(b.column(1))
        parts = [(key, row + at, pos, n) for at, part in W.slices(b.column(2)) for key, row, pos, n in [runs(W.words(part))]]
        if not parts:
            continue
        key, row, pos, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, h[row], k[row], key))
        key, row, pos, n = key[order], row[order], pos[order], n[order]
        later = _later(key, k[row], h[row], pos, n) if len(key) else np.zeros(0, bool)
        again = np.zeros(len(key), bool)                       # the same row twice is the same run
        again[1:] = (key[1:] == key[:-1]) & (k[row][1:] == k[row][:-1]) & (h[row][1:] == h[row][:-1]) & (pos[1:] == pos[:-1])
        key, row, pos, n, later = (x[~again] for x in (key, row, pos, n, later))
        place = np.where(later, W.mix(k[row].astype(np.uint64) ^ h[row].astype(np.uint64)), key)
        yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(later), pa.array(k[row]), pa.array(h[row]),
                                          pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))],
                                         names=[c.split()[0] for c in _SPAN.split(", ")])


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by hash, then identity: the runs that are not the first of their kind."""
    head = None                                               # key and identity of the latest first run
    for b in batches:
        if not b.num_rows:
            continue
        key, later, k, h, pos, n = (np.asarray(b.column(i)) for i in range(6))
        if head is not None:
            key, later, k, h, pos, n = (np.concatenate([[x], c]) for x, c in zip(head, (key, later, k, h, pos, n)))
        known = later.astype(bool)
        out = known.copy()
        own = np.flatnonzero(~known)
        if len(own):
            out[own] = _later(key[own], k[own], h[own], pos[own], n[own])
            same = own[key[own] == key[own[-1]]][0]
        if head is not None:
            out = out[1:]
        if len(own):
            head = (key[same], False, k[same], h[same], pos[same], n[same])
        yield b.select(["k", "h", "pos", "n"]).filter(pa.array(out))


def cleaned(text: pa.LargeStringArray, flags: list[list[tuple[int, int]]]) -> list[tuple[bytes, int, int]]:
    """(text without the words of the flagged runs, sentences, those removed at least in part) of each row of a slice."""
    w = W.words(text)
    bounds, row = sentence_bounds(w)
    of_row = np.searchsorted(row, np.arange(len(text) + 1))
    data, offsets = W.raw(text)
    out = []
    for i, own in enumerate(flags):
        lo, hi = int(of_row[i]), int(of_row[i + 1])
        whole = data[offsets[i]: offsets[i + 1]].tobytes()
        if not own:
            out.append((whole, hi - lo, 0))
            continue
        first, last = int(w.first[i]), int(w.first[i + 1])
        gone = np.zeros(last - first, bool)
        for pos, n in own:
            gone[pos: pos + n] = True
        begin = w.starts[first:last] - offsets[i]
        begin[0] = 0
        turns = np.flatnonzero(np.diff(gone, prepend=True))       # words kept again, then gone again, and so on
        edges = np.append(begin[turns], len(whole)).tolist()
        touched = np.logical_or.reduceat(gone, bounds[lo:hi] - first)
        out.append((b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])), hi - lo, int(touched.sum())))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated runs, plus n_sentences and n_removed
    (sentences removed whole or in part).

    Columns of those two names are replaced. A null text stays null and has no
    sentences. Rows with the same id and text are one document and are cleaned
    alike; null ids come last when the first run is sought. An empty table gives
    no rows. A run is shuffled once a batch of rows, however often it occurs there;
    texts are shuffled once.
    """
    keep = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    keyed = docs.select(F.struct(*keep).alias("doc"), F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("k"),
                        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("h"))
    spans = keyed.select("k", "h", F.col("doc").getField(text_col).cast("string").alias("text")).mapInArrow(_spans, _SPAN)
    flagged = (spans.repartition("p").sortWithinPartitions("p", "later", "k", "h", "pos")
               .mapInArrow(_not_first, "k long, h long, pos int, n int")
               .groupBy("k", "h").agg(F.collect_set(F.struct("pos", "n")).alias("flags")))
    rows = keyed.join(flagged, ["k", "h"], "left").select("doc.*", F.col("flags").alias("_flags"))
    schema = StructType([*docs.select(*keep).schema, StructField("n_sentences", IntegerType()), StructField("n_removed", IntegerType())])
    place = keep.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags, null = b.column(len(keep)).to_pylist(), b.column(place).is_null().to_pylist()
            got = []
            for at, part in W.slices(b.column(place)):
                got += cleaned(part, [[(f["pos"], f["n"]) for f in x or ()] for x in flags[at: at + len(part)]])
            cols = list(b.columns[:len(keep)])
            cols[place] = pa.array([None if z else t.decode() for z, (t, _, _) in zip(null, got)], cols[place].type)
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([g[i] for g in got], pa.int32()) for i in (1, 2)]],
                                             names=[*keep, "n_sentences", "n_removed"])

    return rows.mapInArrow(clean, schema)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words that repeat an earlier run of sentences or span of words."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_sentence_spans": op7_sentence_spans}
ORACLES: dict[str, str] = {}
