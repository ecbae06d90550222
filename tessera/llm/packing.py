"""Packing: documents' token ids into fixed windows by minimum bin slack.

A group of documents is packed at a time. Whole windows are cut off documents
longer than a window; the remaining lengths form a multiset, and each window
takes its largest length plus the multiset that a bitset subset-sum dynamic
program finds closest to the capacity left. Where no multiset is exact, the
largest length still there is cut to close the gap. A group's last ids go to
windows of powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import tokens
from tessera.llm import words as W

CAPACITY = 4096
END = 2
GROUP_TOKENS = 1 << 20     # ids packed together, held by one task at a time
SLICE_BYTES = 1 << 20      # of texts tokenized at once
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long")


def fill(counts: dict[int, int], room: int) -> tuple[dict[int, int], int]:
    """Lengths (with how many of each) from the multiset ``counts`` whose sum is the
    largest one at most ``room``, and that sum.

    Bit s of a Python integer tells that sum s can be reached; each length's
    count is split into powers of two, and the bitset before each step is kept
    to track back. Larger lengths come first; the search ends at an exact fill.
    """
    if room <= 0:
        return {}, 0
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used), total


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) pieces that hold items of these lengths whole.

    Every sequence is ``capacity`` long, but for the last few, which have lengths
    that are descending powers of two. Items of length 0 take part in none.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the window length must be a power of two")
    out: list[list[tuple[int, int, int]]] = []
    rest: dict[int, deque] = defaultdict(deque)
    for item, n in enumerate(lengths):
        whole = n - n % capacity
        out.extend([(item, at, capacity)] for at in range(0, whole, capacity))
        if n > whole:
            rest[n - whole].append((item, whole))
    counts = {n: len(q) for n, q in rest.items()}
    left = sum(n * k for n, k in counts.items())

    def take(length: int) -> tuple[int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return rest[length].popleft()

    while left:
        size = capacity if left >= capacity else 1 << left.bit_length() - 1
        sequence, room = [], size
        largest = max((n for n in counts if n <= size), default=0)
        if largest:
            sequence.append((*take(largest), largest))
            used, total = fill(counts, room - largest)
            room -= largest + total
            sequence += [(*take(n), n) for n, k in sorted(used.items(), reverse=True) for _ in range(k)]
        while room:                                    # no exact fill: cut the largest item there is
            n = max(counts)
            item, start = take(n)
            used_now = min(n, room)
            sequence.append((item, start, used_now))
            room -= used_now
            if n > used_now:
                rest[n - used_now].appendleft((item, start + used_now))
                counts[n - used_now] = counts.get(n - used_now, 0) + 1
        out.append(sequence)
        left -= size
    return out


def _batch(doc_ids: list, ids: list[np.ndarray], first_sequence: int, capacity: int) -> pa.RecordBatch:
    rows = []
    lengths = [len(x) for x in ids]
    for k, sequence in enumerate(pack(lengths, capacity)):
        offset, size = 0, sum(n for _, _, n in sequence)
        for item, start, n in sequence:
            rows.append((doc_ids[item], start, n, zlib.crc32(ids[item][start: start + n].tobytes()), lengths[item],
                         first_sequence + k, offset, size))
            offset += n
    cols = list(zip(*rows)) or [()] * 8
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: its document, place there, length, CRC-32 of its ids, the
    document's ids with the end id, sequence, offset there, and the sequence's length.

    One pass without a shuffle: a task packs its documents in groups of about
    ``group_tokens`` ids, so memory is bounded by that and the longest text. A
    null or empty text has the end id alone. Repeated rows are packed as often as
    they occur; a null doc_id stays null. An empty table gives no rows. Sequence
    ids are unique, not dense: the task's number times 2**33 plus a count; other
    splits of the input give another, equally full packing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.word_encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        doc_ids, ids, held = [], [], 0
        for batch in batches:
            for at, texts in W.slices(batch.column(1), SLICE_BYTES):
                flat, counts = enc.ids_of(texts)
                ends = np.cumsum(counts)
                for doc_id, lo, hi in zip(batch.column(0).slice(at, len(texts)).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    one = np.empty(hi - lo + 1, "<u4")
                    one[:-1], one[-1] = flat[lo:hi], end_id
                    doc_ids.append(doc_id)
                    ids.append(one)
                    held += len(one)
                if held >= group_tokens:
                    out = _batch(doc_ids, ids, sequence, capacity)
                    sequence += held // capacity + 64
                    doc_ids, ids, held = [], [], 0
                    yield out
        if ids:
            yield _batch(doc_ids, ids, sequence, capacity)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)


def tokenizer_path(name: str) -> str:
    """A public tokenizer file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids (no padding is left to add)."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
