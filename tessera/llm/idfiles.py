"""Token-id files: documents in id order, as blocks of an adaptive range coder.

A file is one output partition: Parquet records (file, block, ids, data), where
``data`` is a self-contained block of ``rangecoder`` whose note lists the pieces
of documents in it. Files and blocks are numbered in ascending doc_id order; a
document may go on in the next blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import rangecoder, tokens
from tessera.llm.packing import tokenizer_path
from tessera.session import checkpoint_dir

END = 0
RECORD = "file int, block int, ids long, data binary"
_PIECE = struct.Struct("<qBqqqi")    # doc_id, whether it is null, its number in the file, its place, place of the piece, ids


def _pieces(doc_id: int | None, number: int, place: int, at: int, n: int) -> bytes:
    return _PIECE.pack(doc_id or 0, doc_id is None, number, place, at, n)


def _listed(note: bytes) -> Iterator[tuple]:
    return _PIECE.iter_unpack(note)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each with ``end_id`` after it, to a shared folder.

    Texts are range-partitioned by doc_id, nulls first, and sorted in their
    partition; rows with equal ids come in order of their texts. A null or empty
    text has the end id alone. An empty table writes no record. A task holds the
    ids of one group of blocks, and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        enc = tokens.encoder(tokenizer, tokens.PIECES)
        size, group = rangecoder.BLOCK, rangecoder.LANES
        blocks, notes, held, note, free = [], [], [], b"", size
        number = place = n_blocks = 0

        def out(done: int) -> pa.RecordBatch:
            data = rangecoder.encode_blocks(blocks, notes)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * len(data), pa.int32()), pa.array(range(done, done + len(data)), pa.int32()),
                pa.array([len(b) for b in blocks], pa.int64()), pa.array(data, pa.binary())],
                names=["file", "block", "ids", "data"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                flat, counts = enc.ids(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(part.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype(np.uint32)
                    at = 0
                    while at < len(own):
                        some = own[at: at + free]
                        held.append(some)
                        note += _pieces(doc_id, number, place, at, len(some))
                        at, free = at + len(some), free - len(some)
                        if not free:
                            blocks.append(np.concatenate(held))
                            notes.append(note)
                            held, note, free = [], b"", size
                    number, place = number + 1, place + len(own)
                if len(blocks) >= group:
                    yield out(n_blocks)
                    n_blocks += len(blocks)
                    blocks, notes = [], []
        if held:
            blocks.append(np.concatenate(held))
            notes.append(note)
        if blocks:
            yield out(n_blocks)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, RECORD).write.parquet(folder)


def _read(records: DataFrame, schema: str, emit: Callable[[list], pa.RecordBatch]) -> DataFrame:
    """``emit`` of the (file, doc_id, number, place, at, ids) pieces of decoded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rangecoder.LANES):
                part = b.slice(lo, rangecoder.LANES)
                pieces = []
                for file, block in zip(part.column(0).to_pylist(), rangecoder.decode_blocks(part.column(1).to_pylist())):
                    used = 0
                    for doc_id, null, number, place, at, n in _listed(block.note):
                        pieces.append((file, None if null else doc_id, number, place, at, block.ids[used: used + n]))
                        used += n
                yield emit(pieces)

    return records.select("file", "data").mapInArrow(run, schema)


def _starts(records: DataFrame) -> DataFrame:
    """(file, before): ids of all files before each. One row a file; only their totals are read."""
    totals = sorted((r["file"], r["n"]) for r in records.groupBy("file").agg(F.sum("ids").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])[:-1]]).tolist() if totals else []
    return records.sparkSession.createDataFrame([(f, int(b)) for (f, _), b in zip(totals, before)], "file int, before long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: start is the number of ids before it.

    A null or empty text has its end id alone; null ids come first, repeated rows each have their
    own place, in order of text. Files without a document give no rows; a damaged block is an error.
    """
    records = spark.read.schema(RECORD).parquet(folder)

    def emit(pieces):
        cols = list(zip(*pieces)) or [()] * 6
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["file", "doc_id", "number", "place", "at", "ids"])

    pieces = _read(records, "file int, doc_id long, number long, place long, at long, ids array<long>", emit)
    whole = pieces.groupBy("file", "number").agg(F.first("doc_id").alias("doc_id"), F.first("place").alias("place"),
                                                 F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return whole.join(F.broadcast(_starts(records)), "file").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), F.flatten(F.col("parts.ids")).alias("ids"))


def _apply(matrix: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= matrix[low.bit_length() - 1]
        value ^= low
    return out


def _zero_maps() -> list[list[int]]:
    """What 2**k zero bytes do to a CRC-32 register, as maps of GF(2), each the square of the one before."""
    matrix = [0xEDB88320, *[1 << k for k in range(31)]]         # one zero bit
    out = []
    for k in range(3 + 40):
        matrix = [_apply(matrix, x) for x in matrix] if k else matrix
        out.append(matrix)
    return out[3:]


_ZEROS = _zero_maps()


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings put together, from their (CRC-32, length in bytes)."""
    out = parts[0][0]
    for crc, n in parts[1:]:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _apply(_ZEROS[k], out)
        out ^= crc
    return out


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; odd rows as in ``read_ids``."""
    records = spark.read.schema(RECORD).parquet(folder)

    def emit(pieces):
        rows = [(f, d, k, p, a, len(ids), zlib.crc32(ids.tobytes())) for f, d, k, p, a, ids in pieces]
        cols = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(cols)],
                                          names=["file", "doc_id", "number", "place", "at", "n", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(3).to_pylist()
            crc = [joined_crc([(x["crc"], 4 * x["n"]) for x in p]) for p in parts]
            n = [sum(x["n"] for x in p) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = _read(records, "file int, doc_id long, number long, place long, at long, n long, crc long", emit)
    whole = pieces.groupBy("file", "number").agg(F.first("doc_id").alias("doc_id"), F.first("place").alias("place"),
                                                 F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return whole.join(F.broadcast(_starts(records)), "file") \
        .select("file", "doc_id", (F.col("before") + F.col("place")).alias("start"), "parts") \
        .mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to files in id order and read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_digests(spark, folder)


QUERIES = {"op8_token_ids": op8_token_ids}
ORACLES: dict[str, str] = {}
