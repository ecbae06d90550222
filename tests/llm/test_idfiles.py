"""Exact round trips of the range coder and of the files."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures_llm import SF_SMALL, docs_of  # noqa: F401
from tessera.llm import idfiles, rangecoder
from tessera.llm.packing import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), min_size=1, max_size=400), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    got = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks, [bytes([k]) for k in range(len(blocks))]))
    assert [g.ids.tolist() for g in got] == [b.tolist() for b in blocks]
    assert [g.note for g in got] == [bytes([k]) for k in range(len(blocks))]


def test_full_blocks_and_many_lanes():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, v, rangecoder.BLOCK).astype(np.uint32) for v in (1, 2, 300, 50257)]
    blocks += [(np.arange(rangecoder.BLOCK) % 7).astype(np.uint32), np.minimum(rng.zipf(1.3, rangecoder.BLOCK), 50000).astype(np.uint32)]
    data = rangecoder.encode_blocks(blocks)
    assert all((g.ids == b).all() for g, b in zip(rangecoder.decode_blocks(data), blocks))
    assert len(data[4]) < rangecoder.BLOCK // 16 and len(data[5]) < 2 * rangecoder.BLOCK      # contexts and counts are used
    alone = [rangecoder.encode_blocks([b])[0] for b in blocks]
    assert alone == data                                       # a block doesn't depend on the others


def test_damage_is_found():
    data = rangecoder.encode_blocks([np.arange(500, dtype=np.uint32) * 3 % 11])[0]
    for k in range(0, len(data), 23):
        bad = data[:k] + bytes([data[k] ^ 0x40]) + data[k + 1:]
        if k >= len(data) - 8:
            continue                                           # the flushed tail may not matter
        with pytest.raises((ValueError, IndexError)):
            rangecoder.decode_blocks([bad])
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([data[:-2]])


def test_crc_of_parts():
    data = bytes(range(256)) * 5
    for cuts in ([0, 1280], [0, 1, 1280], [0, 4, 8, 700, 1280], [0, 0, 1280]):
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        assert idfiles.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def plain(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in idfiles.op8_token_ids(spark, SF_SMALL).collect())
    assert got == plain(rows)


def test_edges_of_the_input(spark, docs_of, tmp_path, monkeypatch):
    rows = [(3, "word " * 20_000), (1, None), (2, ""), (2, "b"), (2, "b"), (None, "x y"), (9, "tail\t \n x")]
    path = tokenizer_path("byte_bpe_50k.json")
    docs = docs_of(rows)
    idfiles.write_ids(docs.withColumn("block", docs.doc_id), f"{tmp_path}/a", path)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in idfiles.read_digests(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert got == plain(rows)
    back = {(r.doc_id, r.start): r.ids for r in idfiles.read_ids(spark, f"{tmp_path}/a").collect()}
    assert {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in back.items()} == {(d, s): (n, c) for d, s, n, c in got}
    idfiles.write_ids(docs_of([]), f"{tmp_path}/b", path)
    assert idfiles.read_digests(spark, f"{tmp_path}/b").count() == 0
