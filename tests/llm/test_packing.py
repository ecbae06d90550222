"""Packing: every id in one piece, windows without gaps, and the fill against all subsets."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures_llm import SF_SMALL, docs_of  # noqa: F401
from tessera.llm import packing, tokens


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=5), st.integers(0, 40))
def test_fill_is_the_closest_sum(counts, room):
    used, total = packing.fill(counts, room)
    assert sum(n * k for n, k in used.items()) == total <= room
    assert all(k <= counts[n] for n, k in used.items())
    sums = {sum(n * k for n, k in zip(counts, ks)) for ks in product(*[range(k + 1) for k in counts.values()])}
    assert total == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40))
def test_pack_holds_every_id_once(lengths):
    sequences = packing.pack(lengths, 16)
    held = Counter((item, at) for s in sequences for item, start, n in s for at in range(start, start + n))
    assert held == Counter((i, a) for i, n in enumerate(lengths) for a in range(n))
    sizes = [sum(n for _, _, n in s) for s in sequences]
    assert all(x == 16 or x & (x - 1) == 0 for x in sizes)
    assert sum(x < 16 for x in sizes) <= 4


def test_capacity_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        packing.pack([1], 12)


def check_pieces(rows, ids_of):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            part = np.array(ids_of[d][p.start:p.start + p.length], "<u4")
            assert p.start == at and p.doc_tokens == len(ids_of[d]) and p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids_of[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].sequence_tokens and (at == 4096 or at & (at - 1) == 0)


def test_table(spark):
    from tokenizers import Tokenizer
    path = packing.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ids_of = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2]
              for r in docs.select("doc_id", "text").collect()}
    check_pieces(packing.op3_packing(spark, SF_SMALL).collect(), ids_of)
    check_pieces(packing.pack_documents(docs.repartition(3), path, group_tokens=5000).collect(), ids_of)


def test_edges_of_the_input(spark, docs_of):
    path = packing.tokenizer_path("word_bpe_49k.json")
    docs = docs_of([(1, None), (2, ""), (None, "a b"), (4, "word " * 9000), (4, "word " * 9000)]).withColumn("length", docs_id())
    rows = packing.pack_documents(docs, path).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 3 + 2 * 9001
    assert packing.pack_documents(docs_of([]), path).count() == 0


def docs_id():
    from pyspark.sql import functions as F
    return F.lit("not a number")


ODD = ["a\t b", "! \x1c! a\n\n b  c \n", "", None, "x" * 100 + " <|endoftext|> <|startoftext|>  \n  y ź ́",
       "I'm 's 've a 12 345  \r\nb", "Σ ΑΣ İstanbul   x 　", " lead", "tail ", "\x85\x1f a\x1f ", "é é Å"]


@pytest.mark.parametrize("name,pattern", [("word_bpe_49k.json", tokens.WORDS), ("byte_bpe_50k.json", tokens.PIECES)])
def test_memo_gives_the_library_ids(name, pattern):
    e = tokens.Encoder(packing.tokenizer_path(name), pattern)
    for _ in range(2):
        flat, counts = e.ids(ODD)
        at = 0
        for t, n in zip(ODD, counts):
            assert flat[at:at + n].tolist() == e.tok.encode(t or "", add_special_tokens=False).ids, repr(t)
            at += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ é'sß.,!0\n\t\r\x1c  ́Σ中😀"), max_size=30), max_size=4))
def test_memo_on_random_texts(texts):
    for name, pattern in (("word_bpe_49k.json", tokens.WORDS), ("byte_bpe_50k.json", tokens.PIECES)):
        e = tokens.encoder(packing.tokenizer_path(name), pattern)
        flat, counts = e.ids(texts)
        want = [e.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]


def test_word_encoder_against_the_library():
    """Ids of whole texts, whatever the white space, marks and letters, and when hashes of pieces meet."""
    import random

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.llm import packing, tokens

    path = packing.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rnd = random.Random(3)
    bits = ["The", "end.", "END!!", "a.b.", "x,", "...", "!", "Éa.", "ñandú,", "×.", "÷!", "ß", "日本.", "Σίσυφος.", "don't!", "42.", "a1,", "<|endoftext|>", "😀.", "É", "\x1c", "q" * 300]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "", "\x1d", "\u200b"]
    texts = ["", " ", "\u3000", "A", "end.", ".", "!.,"] + ["".join(rnd.choice(bits) + rnd.choice(gaps) for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    arr = pa.array(texts, pa.large_string())

    def check(enc):
        for _ in range(2):
            flat, counts = enc.ids_of(arr)
            got = np.split(flat, np.cumsum(counts)[:-1])
            assert [g.tolist() for g in got] == want

    check(tokens.WordEncoder(path))
    flat, counts = tokens.WordEncoder(path).ids_of(pa.array([], pa.large_string()))
    assert len(flat) == 0 and len(counts) == 0
    few = tokens.WordEncoder(path)
    few.KEPT_IDS = 10                                   # a fresh table at every call
    check(few)


def test_word_encoder_where_hashes_meet(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessera.llm import packing, tokens

    path = packing.tokenizer_path("word_bpe_49k.json")
    texts = pa.array(["alpha beta gamma", "delta alpha", "beta"], pa.large_string())
    plain = tokens.Encoder(path, tokens.WORDS).ids(texts.to_pylist())
    real = tokens._two_hashes
    monkeypatch.setattr(tokens, "_two_hashes", lambda w: (real(w)[0] % np.uint64(2), real(w)[1]))
    enc = tokens.WordEncoder(path)
    for _ in range(2):
        got = enc.ids_of(texts)
        assert got[0].tolist() == plain[0].tolist() and got[1].tolist() == plain[1].tolist()
