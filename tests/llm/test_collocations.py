"""Collocations against plain counting on small tables (the query itself has DuckDB SQL)."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fixtures_llm import docs_of  # noqa: F401
from tessera.llm import collocations as C


def plain_counts(rows, threshold):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f.update((lang, " ".join(ws[i:i + k])) for i in range(len(ws) - k + 1))
    return n, {k: c for k, c in f.items() if c >= threshold}


def plain(rows, threshold, top, cover=100):
    n, f = plain_counts(rows, threshold)
    out = []
    for lang in {x for x, _ in f}:
        mine = {p: c for (x, p), c in f.items() if x == lang}
        found = []
        for p, a in mine.items():
            ws = p.split(" ")
            if len(ws) < 2:
                continue
            if any(len(q.split(" ")) > len(ws) and f" {p} " in f" {q} " and 100 * c >= cover * a for q, c in mine.items()):
                continue
            cut = min((1000 * a * n[lang] // (mine[" ".join(ws[:k])] * mine[" ".join(ws[k:])]), k) for k in range(1, len(ws)))
            k = cut[1]
            found.append((-cut[0], -a, p.encode(), mine[" ".join(ws[:k])], mine[" ".join(ws[k:])]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, texts=120):
    rnd = random.Random(seed)
    words = ["the", "The", "new", "york", "é", "ß", "\x1cx", "a-b", "\xa0", "日本", "of"] + [f"w{i}" for i in range(30)]
    gaps = [" "] * 12 + ["  ", "\t", " \t ", ", ", ". ", "\n", ";", "!?", "\r\n"]
    rows = []
    for _ in range(texts):
        t = "".join(rnd.choice(["new york city ", "of the "]) if rnd.random() < 0.2 else rnd.choice(words) + rnd.choice(gaps)
                    for _ in range(rnd.randrange(60)))
        rows.append((rnd.choice(["en", "de", None, "", "EN"]), t))
    return rows + [("en", None), (None, None), ("fr", ""), ("xx", " . "), ("en", "one" * 5000), ("en", "same line again\n" * 50)] * 2


@pytest.mark.parametrize("seed,threshold,slack,round_keys", [(1, 4, 8, 1 << 20), (2, 3, 1, 40), (3, 2, 1, 1 << 20)])
def test_matches_plain(spark, docs_of, seed, threshold, slack, round_keys):
    rows = corpus(seed)
    docs = docs_of([(i, t, lang) for i, (lang, t) in enumerate(rows)]).repartition(5)
    counts = C.frequent(docs, threshold, slack=slack, buffer_keys=3000, round_keys=round_keys, held_phrases=50)
    got = {(r.lang, r.phrase): r.n for r in counts.collect()}
    n, f = plain_counts(rows, threshold)
    assert {k: v for k, v in got.items() if k[1]} == f
    assert {k[0]: v for k, v in got.items() if not k[1] and v} == {k: v for k, v in n.items() if v}
    for top in (7, 10_000):
        assert sorted(tuple(r) for r in C.collocations(counts, top).collect()) == plain(rows, threshold, top)
    assert sorted(tuple(r) for r in C.collocations(counts, 50, 60).collect()) == plain(rows, threshold, 50, 60)


def test_hot_text_and_extra_columns(spark):
    """A third of all rows one text; the caller's columns named like the operator's own don't matter."""
    rows = [("en", "big hot text here, big hot text")] * 400 + [("en", f"u{i} v{i}") for i in range(800)]
    docs = spark.createDataFrame([(a, b, "x", 1, b"k", 0) for a, b in rows], "lang string, text string, phrase string, n int, keys binary, part int")
    got = {(r.lang, r.phrase): r.n for r in C.frequent(docs.repartition(3), 100).collect()}
    n, f = plain_counts(rows, 100)
    assert got == f | {("en", ""): n["en"]}


def test_empty_tables(spark, docs_of):
    for rows in ([], [(1, None, None)], [(1, "", "en")], [(1, "rare words only", "en")]):
        counts = C.frequent(docs_of(rows))
        assert counts.where("phrase <> ''").count() == 0 and C.collocations(counts).count() == 0


def test_exact_large_products(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "", big), ("en", "a", big - 1), ("en", "b", big - 3), ("en", "a b", big - 7)], "lang string, phrase string, n long")
    r = C.collocations(counts).first()
    assert r.score == 1000 * (big - 7) * big // ((big - 1) * (big - 3))


def test_summary_keeps_every_frequent_key():
    """Whatever the order of merging, at most ``capacity`` keys stay and each that reaches the threshold is one."""
    rnd = np.random.default_rng(5)
    for threshold in (5, 40):
        keys = np.concatenate([rnd.integers(0, 5000, 60_000), np.repeat(rnd.integers(0, 5000, 30), threshold)]).astype(np.uint64)
        rnd.shuffle(keys)
        s = C.Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 50):
            s.add(*C.counted(part))
            s.fold()
            assert len(s.keys) <= s.capacity
        true = Counter(keys.tolist())
        assert s.error < threshold
        assert {k for k, c in true.items() if c >= threshold} <= set(s.survivors(threshold).tolist())
        assert all(true[k] - s.error <= c <= true[k] for k, c in zip(s.keys.tolist(), s.counts.tolist()))


def test_packing_of_keys():
    for keys in ([0], [7, 8, 1 << 40], [1 << 59], list(range(1000))):
        a = np.array(keys, np.uint64)
        assert C.unpack_keys(*C.pack_keys(a)).tolist() == keys
    assert C.unpack(C.pack(np.array([1, 300, 70_000]))).tolist() == [1, 300, 70_000]
