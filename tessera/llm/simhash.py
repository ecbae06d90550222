"""SimHash near-duplicates: fingerprints linked through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of
their 8 positional bytes, so at least 8 - d positional bytes agree: the count
filter's guaranteed minimum. An index entry is a combination of that many
positional bytes, so exactly the pairs whose tally of shared positional bytes
reaches the minimum meet in an entry, and no pair below it is ever formed. The
bit distance is verified inside each entry, where linked fingerprints leave the
entry as one star and not as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.graph import components
from tessera.session import materialize

SHINGLE = 4
DISTANCE = 4
SEED = 42


def _joined(w: W.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each word begins and ends there."""
    lens = w.ends - w.starts
    begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(lens) else np.zeros(0, np.int64)
    out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[inner + np.repeat(begin, lens)] = w.buf[inner + np.repeat(w.starts, lens)]
    return out.tobytes(), begin, begin + lens


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text (uint64; 0 where a text has no word)."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for at, part in W.slices(texts):
        w = W.words(part)
        n_words = np.diff(w.first)
        runs = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
        total = int(runs.sum())
        if not total:
            continue
        data, begin, end = _joined(w)
        upto = np.cumsum(runs)
        row = np.repeat(np.arange(len(runs)), runs)
        one = np.arange(total) - (upto - runs)[row] + w.first[:-1][row]
        last = np.minimum(one + shingle, w.first[1:][row]) - 1
        h = np.fromiter((digest(data[s:e], seed) for s, e in zip(begin[one].tolist(), end[last].tolist())),
                        np.uint64, total)
        some = np.flatnonzero(runs)
        for lo in range(0, len(some), 4096):
            rows = some[lo: lo + 4096]
            a, b = int((upto - runs)[rows[0]]), int(upto[rows[-1]])
            bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (upto - runs)[rows] - a, axis=0, dtype=np.int64)
            packed = np.packbits(2 * ones > runs[rows][:, None], axis=1, bitorder="little")
            out[at + rows] = packed.reshape(-1).view("<u8")
    return out


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle, seed).view(np.int64))],
                                             names=["doc_id", "fp"])
    return run


def _entries(distance: int):
    """(entry, fp) rows: one for each combination of 8 - distance positional bytes."""
    combos = list(combinations(range(8), 8 - distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).astype("<i8").view("<u8")
            for lo in range(0, len(fp), 1 << 14):
                some = fp[lo: lo + (1 << 14)]
                parts = some.view(np.uint8).reshape(-1, 8).astype(np.uint64)
                for k, combo in enumerate(combos):
                    key = np.full(len(some), k, np.uint64)
                    for i in combo:
                        key = key << np.uint64(8) | parts[:, i]
                    key = key if 8 * len(combo) < 56 else W.mix(key ^ np.uint64(k) << np.uint64(57))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(some.view(np.int64))],
                                                     names=["entry", "fp"])
    return run


def stars(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (seed, member) that connect all fingerprints (distinct) linked inside one entry."""
    out, left = [], fps
    while len(left) > 1:
        seed, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= distance
            if near.any():
                new = left[near]
                left = left[~near]
                todo.extend(new)
                out.extend((int(seed), int(x)) for x in new)
    return out


def _links(distance: int):
    """Stars of the entries in a partition sorted by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(key, fp):
            edge = np.flatnonzero(np.diff(key)) + 1
            bounds = np.concatenate([[0], edge, [len(key)]])
            out = []
            for a in np.flatnonzero(np.diff(bounds) > 1):
                out += stars(fp[bounds[a]: bounds[a + 1]], distance)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate([rest_key, np.asarray(b.column(0))])
            fp = np.concatenate([rest, np.asarray(b.column(1)).view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1]))     # the last entry may go on in the next batch
            rest_key, rest = key[whole:], fp[whole:]
            if whole:
                yield linked(key[:whole], fp[:whole])
        if len(rest):
            yield linked(rest_key, rest)
    return run


def fingerprint_links(reps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) edges that connect exactly the fingerprints linked at ``distance`` or fewer bits.

    ``reps``: distinct fingerprints in a long column ``fp``. The distance is 0 to
    7; from 8 on no positional byte is sure to agree.
    """
    if not 0 <= distance < 8:
        raise ValueError("the count filter needs a distance below 8")
    entries = reps.select("fp").mapInArrow(_entries(distance), "entry long, fp long")
    return entries.repartition("entry").sortWithinPartitions("entry", "fp") \
        .mapInArrow(_links(distance), "u long, v long").dropDuplicates()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at ``distance`` or fewer bits link; component_id is the smallest
    doc_id in the component. Equal fingerprints are one node, however many
    documents have them. Texts without a word (null, empty, blank) have
    fingerprint 0 and are linked through it like any others. Repeated rows stay
    repeated; rows are joined through fingerprints only. A null doc_id is kept
    and is no smallest id (null if the component has no other). An empty table
    gives no rows; other columns are not read.
    """
    fps = materialize(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
                      .mapInArrow(_fingerprint_batches(shingle, seed), "doc_id long, fp long"))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(reps, distance)).withColumnRenamed("node", "fp")
    labelled = materialize(reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(lowest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """The documents (all their columns) without near-duplicates: of each component
    the row of smallest doc_id, nulls last, then of smallest text hash.

    Rows with the same doc_id and text are one document; the first by lang, source
    and the other columns stays. Texts are shuffled once, by that key.
    """
    key, text_hash, rank = (next(f"_{n}{k}" for k in range(99) if f"_{n}{k}" not in docs.columns) for n in ("key", "hash", "rank"))
    # One long that sorts like doc_id with nulls last, so that a plain equality joins it.
    keyed = docs.withColumn(key, F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1))) \
        .withColumn(text_hash, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprints(b.column(2), shingle, seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["k", "h", "fp"])

    fps = materialize(keyed.select(F.col(key), F.col(text_hash), docs["text"].cast("string"))
                      .mapInArrow(run, "k long, h long, fp long"))
    first = fps.groupBy("fp").agg(F.min(F.struct("k", "h")).alias("least"))
    roots = components(fingerprint_links(first, distance)).withColumnRenamed("node", "fp")
    kept = (first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
            .select(F.col("least.k").alias(key), F.col("least.h").alias(text_hash)).dropDuplicates())
    order = Window.partitionBy(key, text_hash).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], "text")
    return keyed.join(kept, [key, text_hash]).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1) \
        .select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (4-word shingles, at most 4 bits)."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
