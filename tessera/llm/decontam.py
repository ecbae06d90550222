"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity says
nothing; what counts is the share of an item's word shingles that a document
contains. Each item is sketched by the shingles that are minimal under k hash
functions: each is in a document with a probability equal to the containment,
so a document holding ``threshold`` of an item misses all k with probability
(1 - threshold)**k. Items are partitioned by size (powers of two of their
shingles): classes no larger than k keep every shingle and cannot miss, larger
ones take k minima. Candidates are verified by exact containment on the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-12              # accepted chance to miss a pair at the threshold
BLOCK_SHINGLES = 1 << 20  # benchmark shingles held by a task at a time; more items make more passes
_BITS = 22                # of the filter in front of the sketch


@dataclass
class Block:
    """Items (id, shingles) of one pass and their sketch, sorted by hash."""

    ids: list = field(default_factory=list)
    shingles: list[frozenset[str]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)      # words of a shingle; fewer only for items shorter than that
    sketch: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def runs_of(text: str | None, size: int) -> tuple[set[str], int]:
    """Distinct shingles of a text, and words in each: ``size``, or all of a shorter text's."""
    arr = pa.array([text or ""], pa.large_string())
    w = W.words(arr)
    data = w.buf.tobytes()
    got = [data[s:e].decode("utf-8", "replace") for s, e in zip(w.starts, w.ends)]
    size = min(size, len(got))
    return ({" ".join(got[i:i + size]) for i in range(len(got) - size + 1)} if size else set()), size


def _minima(n_hashes: int, h: np.ndarray) -> np.ndarray:
    """The hashes that are least under each of ``n_hashes`` mixings; all, if there are no more than that."""
    if len(h) <= n_hashes:
        return h
    salts = W.mix(np.arange(1, n_hashes + 1, dtype=np.uint64))
    return np.unique(h[np.argmin(W.mix(h[None, :] ^ salts[:, None]), axis=1)])


def item_block(items: list[tuple], size: int, threshold: float, miss: float = MISS) -> Block:
    """Sketch of a block of (id, text) items. Items without a word match nothing."""
    block, rows = Block(), []
    n_hashes = math.ceil(math.log(miss) / math.log(1 - threshold)) if threshold < 1 else 1
    by_class: dict[int, list[int]] = {}
    for item_id, text in items:
        shingles, words_each = runs_of(text, size)
        if shingles:
            by_class.setdefault((len(shingles)).bit_length(), []).append(len(block.ids))
            block.ids.append(item_id)
            block.shingles.append(frozenset(shingles))
            block.sizes.append(words_each)
    for members in by_class.values():
        for k in members:
            texts = pa.array(sorted(block.shingles[k]), pa.large_string())
            w = W.words(texts)
            h, _, _ = W.windows(W.hashes(w), w.first, block.sizes[k])
            rows += [(block.sizes[k], x, k) for x in _minima(n_hashes, h).tolist()]
    for words_each in sorted({r[0] for r in rows}):
        own = sorted((x, k) for s, x, k in rows if s == words_each)
        block.sketch[words_each] = (np.array([x for x, _ in own], np.uint64), np.array([k for _, k in own], np.int64))
    return block


def matches(texts: pa.Array, block: Block, threshold: float) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) of every text that contains ``threshold`` of an item."""
    out = []
    filters = {}
    for n, (keys, _) in block.sketch.items():
        filters[n] = np.zeros(1 << _BITS, bool)
        filters[n][(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    for at, part in W.slices(texts):
        w = W.words(part)
        h = W.hashes(w)
        found: set[tuple[int, int]] = set()
        for n, (keys, owner) in block.sketch.items():
            run, _, row = W.windows(h, w.first, n)
            some = filters[n][(run >> np.uint64(64 - _BITS)).astype(np.int64)]
            run, row = run[some], row[some]
            lo, hi = np.searchsorted(keys, run, "left"), np.searchsorted(keys, run, "right")
            for i in np.flatnonzero(hi > lo):
                found.update((int(row[i]), int(k)) for k in owner[lo[i]:hi[i]])
        by_row: dict[int, list[int]] = {}
        for r, k in found:
            by_row.setdefault(r, []).append(k)
        for r, items in by_row.items():
            text = part[r].as_py()
            sets = {n: runs_of(text, n) for n in {block.sizes[k] for k in items}}
            for k in items:
                own, n = sets[block.sizes[k]]
                shared = len(block.shingles[k] & own) if n == block.sizes[k] else 0
                if shared >= threshold * len(block.shingles[k]) - 1e-9:
                    out.append((at + r, k, shared))
    return out


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SHINGLE,
           threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> Iterator[Block]:
    """The benchmark, streamed to the driver and cut into blocks of bounded size."""
    held, n = [], 0
    for row in items.select(items[id_col], items[text_col].cast("string")).toLocalIterator():
        text = row[1] or ""
        held.append((row[0], text))
        n += len(text) // 2 + 1          # no text has more shingles than that
        if n >= block_shingles:
            yield item_block(held, size, threshold)
            held, n = [], 0
    if held:
        yield item_block(held, size, threshold)


def contained(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD,
              block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per (document, item) with containment of at least ``threshold``:
    doc_id, item_id, item_shingles, shared, containment.

    A pass over all whole documents for each block of items, without a shuffle;
    a task holds one block. Items with fewer than ``size`` words are one shingle
    of that length; items and documents without a word match nothing. Repeated
    documents and items give repeated rows; null ids stay null; an empty table on
    either side gives no rows. Other columns are not read.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, item_shingles long, shared long, containment double"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for k, block in enumerate(blocks(items, size=size, threshold=threshold, block_shingles=block_shingles)):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                got = sorted(matches(b.column(1), own, threshold))
                doc_ids = b.column(0)
                n = [len(own.shingles[k]) for _, k, _ in got]
                yield pa.RecordBatch.from_arrays([
                    doc_ids.take(pa.array([r for r, _, _ in got], pa.int64())),
                    pa.array([own.ids[k] for _, k, _ in got], pa.int64()), pa.array(n, pa.int64()),
                    pa.array([s for _, _, s in got], pa.int64()),
                    pa.array([s / m for (_, _, s), m in zip(got, n)], pa.float64())],
                    names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        found = rows.mapInArrow(run, schema)
        out = out.unionByName(found) if k else found
    return out


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD,
                  block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents (all their columns) that contain no item to ``threshold`` or more.

    Null and empty texts contain nothing and stay, items without a word are in nothing, so with an
    empty benchmark all documents stay. Repeated rows stay or go alike; null ids and columns of any
    name are carried along. An empty table gives no rows.
    """
    spark, place = docs.sparkSession, docs.columns.index("text")
    for block in blocks(items, size=size, threshold=threshold, block_shingles=block_shingles):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, _, _ in matches(b.column(place), sent.value, threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains (five-word shingles, 0.8 or more)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""WITH items AS (SELECT row_number() OVER () AS k, item_id, {_WORDS_SQL} AS ws FROM benchmark),
sized AS (SELECT k, item_id, ws, least({SHINGLE}, len(ws)) AS m FROM items WHERE len(ws) > 0),
item_runs AS (SELECT DISTINCT k, m, run FROM (SELECT k, m,
  unnest(list_transform(range(1, len(ws) - m + 2), lambda p: array_to_string(ws[p:p + m - 1], ' '))) AS run FROM sized)),
totals AS (SELECT k, count(*) AS n FROM item_runs GROUP BY k),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents),
doc_runs AS (SELECT DISTINCT r, m, run FROM (SELECT r, m,
  unnest(list_transform(range(1, len(ws) - m + 2), lambda p: array_to_string(ws[p:p + m - 1], ' '))) AS run
  FROM d, (SELECT DISTINCT m FROM sized) WHERE len(ws) >= m)),
shared AS (SELECT r, k, count(*) AS c FROM doc_runs JOIN item_runs USING (m, run) GROUP BY r, k)
SELECT doc_id, item_id, n AS item_shingles, c AS shared, c / n AS containment
FROM shared JOIN totals USING (k) JOIN d USING (r) JOIN items USING (k) WHERE c >= {THRESHOLD} * n - 1e-9"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": ORACLE}
