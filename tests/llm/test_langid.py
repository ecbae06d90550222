"""Rank-order profiles against a plain implementation, and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures_llm import docs_of  # noqa: F401
from tessera.llm import langid


def low(c):
    x = c.lower()
    return x if len(x) == 1 else c


def plain_grams(text):
    """Gram strings with a blank at word edges; lengths 1 to 3."""
    out = Counter()
    padded = " " + "".join(low(c) if c.isalpha() else " " for c in text) + " "
    for i in range(1, len(padded) - 1):
        if padded[i] != " ":
            out[padded[i]] += 1
            out[padded[i - 1:i + 1]] += 1
            if padded[i + 1] == " ":
                out[padded[i:i + 2]] += 1
            out[padded[i - 1:i + 2]] += 1
    return out


def number(g):
    out = 0
    for c in g:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbÉé ß.\n1中Σ😀İ"), max_size=20), max_size=5))
def test_grams_match_plain(texts):
    row, gram, count = langid.grams(pa.array(texts, pa.large_string()))
    got = {(r, g): c for r, g, c in zip(row.tolist(), gram.tolist(), count.tolist())}
    assert got == {(i, number(g)): c for i, t in enumerate(texts) for g, c in plain_grams(t).items()}


def test_distance_matches_plain():
    texts = ["the cat and the hat", "der Hund und die Katze", "x", "", "12 34"]
    train = {"de": "der die das und der Hund", "en": "the a an and the cat sat"}

    def top(t, n):
        return [number(g) for g, _ in sorted(plain_grams(t).items(), key=lambda x: (-x[1], number(x[0])))[:n]]
    prof = {k: top(t, 30) for k, t in train.items()}
    known = sorted({g for p in prof.values() for g in p})
    ranks = np.array([[prof[k].index(g) if g in prof[k] else -1 for k in sorted(prof)] for g in known])
    p = langid.Profiles(sorted(prof), np.array(known, np.uint64), ranks, 30)
    d, n = langid.distances(pa.array(texts, pa.large_string()), p, 20)
    for i, t in enumerate(texts):
        own = top(t, 20)
        assert n[i] == len(own)
        for j, k in enumerate(sorted(prof)):
            assert d[i, j] == sum(min(abs(prof[k].index(g) - r), 30) if g in prof[k] else 30 for r, g in enumerate(own))
    assert langid.predict(pa.array(texts), p, 20)[0] == ["en", "de", langid.predict(pa.array(["x"]), p, 20)[0][0], "und", "und"]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = langid.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges_of_the_input(spark, docs_of):
    docs = docs_of([(1, "the cat and the hat", "en"), (1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"),
                    (3, None, "en"), (4, "", "de"), (5, "12 ?", None), (None, "and the cat", None), (6, "the " * 50_000, None)])
    p = langid.learn(docs)
    got = {(r.doc_id, r.text[:9] if r.text else r.text): (r.lang_pred, r.score) for r in langid.identify(docs.withColumn("score", docs.lang), p).collect()}
    assert got[(1, "the cat a")][0] == "en" and got[(None, "and the c")][0] == "en" and got[(6, "the the t")][0] == "en"
    assert got[(3, None)] == got[(4, "")] == got[(5, "12 ?")] == ("und", 0.0)
    assert langid.identify(docs, p).count() == 8
    none = langid.learn(docs_of([(1, "a", None), (2, None, "en")]))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs_of([]), p).count() == 0
