"""The suffix tree against a dictionary implementation, base scores against plain counting."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from fixtures_llm import SF_SMALL, docs_of  # noqa: F401
from tessera.llm import suffixtree as S
from tessera.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


class Plain:
    """The rule over dictionaries of symbol tuples; a text is its start, words and end."""

    def __init__(self, texts, order, least, state, gain, prior):
        seqs = [["<start>", *toks(t)] for t in texts]
        self.c = Counter(x for s in seqs for x in s[1:])
        self.n, self.v, self.prior = sum(self.c.values()), len(self.c), prior
        self.kept = {}
        for k in range(1, order + 1):
            pairs = defaultdict(Counter)
            for s in seqs:
                for i in range(k, len(s)):
                    pairs[tuple(s[i - k:i])][s[i]] += 1
            new = {}
            for ctx, nxt in pairs.items():
                total, own = sum(nxt.values()), {w: n for w, n in nxt.items() if n >= least}
                if total < max(state, least) or not own:
                    continue
                rest = total - sum(own.values())
                g = sum(n * math.log(((n - 1) / self.p(ctx[1:], w) + rest + prior) / (total - 1 + prior)) for w, n in own.items())
                g += rest * math.log(max(rest + prior - 1, prior) / (total - 1 + prior))
                if g >= gain:
                    new[ctx] = (own, total, rest)
            self.kept |= new

    def root(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, ctx, w):
        while ctx and ctx not in self.kept:
            ctx = ctx[1:]
        if not ctx:
            return self.root(w)
        own, total, rest = self.kept[ctx]
        return (own.get(w, 0) + (self.prior + rest) * self.p(ctx[1:], w)) / (total + self.prior)

    def score(self, text, order):
        ids, base, own = ["<start>"], 0.0, 0.0
        for x in toks(text):
            base += math.log10(self.root(x))
            own += math.log10(self.p(tuple(ids[-order:]), x))
            ids.append(x)
        return base, own


@pytest.mark.parametrize("order,least,state,gain,prior,bits,head", [(2, 2, 2, 10.0, 1.0, 1 << 30, 300), (3, 2, 4, 3.0, 5.0, 1 << 20, 1 << 18), (1, 3, 5, 0.5, 20.0, 1 << 15, 0)])
def test_table_against_plain(spark, order, least, state, gain, prior, bits, head):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    options = {"order": order, "least": least, "state": state, "gain": gain, "prior": prior}
    want = Plain([r.text for r in rows if not held[r.doc_id]], **options)
    got = S.score(docs, S._held_out(docs["doc_id"], 5, 1), chunk_bytes=60_000, filter_bits=bits, head=head, **options).collect()
    assert len(got) == len(rows) and len(want.kept) > 1
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        t = toks(texts[r.doc_id])
        base, own = want.score(texts[r.doc_id], order)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(want.c[x] > 0 for x in t), want.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)


def test_distributions_sum_to_one():
    texts = ["a b c a b c d", "a b c e", "b c a b d", "a b", "a b c"] * 3
    plain = Plain(texts, 2, 2, 2, 0.5, 1.0)
    assert plain.kept
    unknown = plain.root("never seen")
    for ctx in plain.kept:
        assert sum(plain.p(ctx, w) for w in plain.c) + plain.p(ctx, "never seen") == pytest.approx(1.0)
        assert plain.p(ctx, "never seen") <= unknown


def states_of(spark, texts, **options):
    return S.tree(spark.createDataFrame([(t,) for t in texts], "text string"), **options)[0].where("left IS NOT NULL").count()


def test_tree_grows_with_the_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect() if r.text]
    few, more, all_ = (states_of(spark, texts[:n]) for n in (len(texts) // 4, len(texts) // 2, len(texts)))
    assert 1.3 * few < more and 1.3 * more < all_


def test_a_text_seen_before_scores_higher(spark, docs_of):
    """Two copies in training make states, whose suffixes have little left for the same words in another order."""
    words = [f"w{i}" for i in range(400)]
    twice, other = " ".join(words[:150]), " ".join(words[150:300])
    many = " ".join(f"v{i}" for i in range(5000))
    docs = docs_of([(i, f"{twice} x{i}") for i in (1, 2)] + [(3, other), (0, many), (4, twice), (5, " ".join(reversed(words[:150])))])
    got = {r.doc_id: r for r in S.score(docs, docs["doc_id"].isin(4, 5)).collect()}
    assert got[4].score - got[4].base_score > 100 and got[5].score < got[5].base_score


def test_filter_knows_its_keys(spark):
    rng = np.random.default_rng(5)
    keys = np.append(rng.integers(-2 ** 63, 2 ** 63, 5000), [0, -1, 2 ** 63 - 1])
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for limit in (1 << 30, 1 << 15):
        f = S.Filter(df, limit)
        assert f.has(keys.view(np.uint64)).all()
    assert S.Filter(df).has(rng.integers(0, 2 ** 63, 20_000).view(np.uint64)).mean() < 0.05
    assert not S.Filter(df.where("false")).has(keys.view(np.uint64)).any()


def test_only_tables_that_are_read_later_stay(spark, docs_of):
    """A step's tables go once the next one is written: the chunks and the answers to them are left."""
    top = urlparse(S.checkpoint_dir(spark)).path
    before = set(os.listdir(top))
    docs = docs_of([(i, f"a b c a b d w{i}") for i in range(40)])
    got = S.score(docs, S._held_out(docs["doc_id"], 5, 1))
    made = [f"{top}/{name}" for name in set(os.listdir(top)) - before]
    assert sorted(table for folder in made for table in os.listdir(folder)) == ["answers", "chunks"]
    assert got.count() == 40


def test_chunks_ask_for_what_they_need():
    """Words that occur once in training are asked for by held-out texts only."""
    class Keys:
        def __init__(self, *words):
            self.keys = W.hashes(W.words(pa.array([" ".join(words)], pa.large_string())))

        def has(self, key):
            return np.isin(key, self.keys)

    chunk = pa.table({"text": ["often once", "often new"], "held_out": [False, True]})
    got = S._asked(S._symbols(chunk), S._trained(chunk), 2, Keys(), Keys("often"), np.zeros(0, np.uint64))
    assert np.isin(Keys("often", "new").keys, got).all() and not np.isin(Keys("once").keys, got).any()


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2 ** 64 - 1, 1000, dtype=np.uint64))
    some = [(r, S._unpacked(S._packed(np.diff(keys[a:b], prepend=np.uint64(0))), b - a, np.uint64)[0]) for r, a, b in S._ranges(keys, 6)]
    assert (np.concatenate([np.cumsum(d, dtype=np.uint64) for _, d in some]) == keys).all()
    assert all((np.cumsum(d, dtype=np.uint64) >> np.uint64(58) == r).all() for r, d in some)
    n, p = np.arange(-1, 20), np.append(rng.random(20), np.nan)
    got = S._unpacked(S._packed(n, p), 21, np.int64, np.float64)
    assert (got[0] == n).all() and np.array_equal(got[1], p, equal_nan=True)


def test_held_out_gain(spark):
    rows = [r for r in S.op1_suffix_tree(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges_of_the_input(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "a b a b"), (3, "a b " * 40_000), (3, "x y"), (3, "x y"), (4, " \n ")]
    docs = docs_of(rows).withColumnRenamed("lang", "chunk")
    got = S.score(docs, S._held_out(docs["doc_id"], 5, 1)).collect()
    assert len(got) == 7 and all(r.score <= 0 and r.base_score <= 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 3, 5, 80_001]
    empty = docs_of([])
    assert S.score(empty, S._held_out(empty["doc_id"], 5, 1)).count() == 0
    none = S.score(docs, docs["doc_id"].isNotNull() | docs["doc_id"].isNull()).collect()
    assert len(none) == 7 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_words_match_the_pattern():
    texts = ["a  B\tc\x0b", "", "é\x1cx y", " ", "Z", "z" * 10_000 + " q"]
    w = W.words(pa.array(texts, pa.large_string()))
    data = w.buf.tobytes()
    got = [[data[s:e].decode() for s, e, r in zip(w.starts, w.ends, w.row) if r == i] for i in range(len(texts))]
    assert got == [WORD.findall(t.translate(LOWER)) for t in texts]
    h = W.hashes(w)
    seen = {}
    for x, k in zip(h.tolist(), [x for g in got for x in g]):
        assert seen.setdefault(x, k) == k
    assert len(set(h.tolist())) == len({x for g in got for x in g})


def test_counts_of_grams_are_shuffled_packed():
    """One row a range of keys, far smaller than its grams' two keys and count; the sums are the plain counts."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.2, 4000), 3000)) for _ in range(40)]
    want = Counter(g for t in texts for g in zip(["<start>", *toks(t)], toks(t)))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i::4])], names=["text"]) for i in range(4)]
    rows = [b for one in batches for b in S._gram_counts(1, lambda levels, left: left > 0, 4)([one])]
    assert sum(b.num_rows for b in rows) == 4 * 16
    assert sum(b.nbytes for b in rows) < 0.5 * 24 * sum(sum(b.column("size").to_pylist()) for b in rows)
    table = pa.Table.from_batches(rows)
    got = [S._gram_sums(least)(table.filter(pa.compute.equal(table.column("part"), p))) for least in (1, 2) for p in range(16)]
    for least, some in ((1, got[:16]), (2, got[16:])):
        n = [x for t in some for x in t.column("n").to_pylist()]
        assert sorted(n) == sorted(c for c in want.values() if c >= least)
        keys = [x for t in some for x in t.column("key").to_pylist()]
        assert len(set(keys)) == len(keys)


def test_portions_are_scored_as_the_whole(spark, docs_of, monkeypatch):
    """Chunks in portions give the same rows as all at once, and only the last portion's answers stay."""
    docs = docs_of([(i, f"a b c a b d w{i % 7} a b x{i}") for i in range(60)]).repartition(6)
    held = S._held_out(docs["doc_id"], 5, 1)
    whole = sorted(tuple(r) for r in S.score(docs, held, chunk_bytes=100).collect())
    assert len(whole) == 60
    monkeypatch.setattr(S, "WHOLE", 2)
    top = urlparse(S.checkpoint_dir(spark)).path
    before = set(os.listdir(top))
    got = S.score(docs, held, chunk_bytes=100)
    made = [f"{top}/{name}" for name in set(os.listdir(top)) - before]
    assert sorted(table for folder in made for table in os.listdir(folder)) == ["answers", "chunks", "scores-0", "scores-1"]
    assert sorted(tuple(r) for r in got.collect()) == whole


def test_index_finds_what_a_search_finds():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 1000):
        known = np.unique(rng.integers(0, 2 ** 64 - 1, n, dtype=np.uint64, endpoint=True))
        g = np.concatenate([known, known + np.uint64(1), rng.integers(0, 2 ** 64 - 1, 500, dtype=np.uint64), np.array([0, 2 ** 64 - 1], np.uint64)])
        assert (S._Index(known).places(g) == S._places(known, g)).all()
    close = np.arange(5, 900, dtype=np.uint64)                 # all in one part of the table
    assert (S._Index(close).places(np.arange(1000, dtype=np.uint64)) == S._places(close, np.arange(1000, dtype=np.uint64))).all()
