"""Importance resampling against plain Python on small tables (the query itself has DuckDB SQL)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import resample as S
from tessera.llm import runs as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def buckets(text, m=S.BUCKETS):
    ws = words(text)
    return [zlib.crc32(f.encode()) % m for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]]


def plain(rows, target, share=25, least=20):
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    s_all, t_all, m = sum(s.values()), sum(t.values()), S.BUCKETS
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * float(s_all + m) / ((s[b] + 1.0) * float(t_all + m)))) for b in range(m)]
    out = []
    for i, x in rows:
        b = buckets(x)
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[:share * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def texts(seed, n=90):
    rnd = random.Random(seed)
    pool = ["the", "The", "Ünder", "ß", "日本語", "a1", "42", "don't", "x-y", "😀", "\x00", "q" * 63, "q" * 64, "q" * 65, "é" * 300] + [f"w{i}" for i in range(40)]
    return ["".join(rnd.choice(pool) + rnd.choice([" ", "\n", ".", "  "]) for _ in range(rnd.randrange(80))) for _ in range(n)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("m", [10_000, 7])
def test_features_match_zlib(m):
    given = texts(1) + ["", None, "one", "A" * 2000 + " b " + "C" * 70, "ends with Ü", "Ü begins"]
    w = R.runs(pa.array([x or "" for x in given], pa.large_string()), S._INSIDE)
    row, bucket = S.features(w, m)
    for i, x in enumerate(given):
        assert sorted(bucket[row == i].tolist()) == sorted(buckets(x, m))


def test_matches_plain(spark):
    rows = list(enumerate(texts(2, 150) + [None, "", "few words"] * 3)) + [(None, "null id " * 20)] + [(5000, "copy of text " * 10)]
    target = ["the w1 w2 the w3", None, "", "日本語 the ß w1"]
    docs = spark.createDataFrame([(i, t, "r", 9, "o") for i, t in rows], "doc_id long, text string, rank string, score int, own string").repartition(4)
    got = S.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert got[0].own == "o"
    want = plain(rows, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=key) == sorted(want, key=key)


def test_ties_and_repeated_rows(spark):
    """Equal scores go by id, null ids last; of repeated rows just as many are drawn as there is room for."""
    rows = [(i % 7 if i % 5 else None, (i * i) % 4) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, score long").repartition(6)
    for share in (0, 1, 13, 25, 50, 99, 100):
        got = S.draw(docs, F.lit(True), share, accuracy=100).collect()
        want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        k = share * len(rows) // 100
        drawn = sorted((r["rank"], (r.doc_id, r.score)) for r in got if r["rank"] is not None)
        assert [r for r, _ in drawn] == list(range(1, k + 1)) and [x for _, x in drawn] == want[:k]
        assert Counter((r.doc_id, r.score) for r in got) == Counter(rows)


def test_bracket_is_widened(spark):
    """A bracket that misses the cutoff is widened until exact counts hold it."""
    calls = []
    scores = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("score"))

    class Missing:
        def agg(self, *cols):
            calls.append(1)
            return scores.where("score < 0").agg(F.expr("array(5, 9)")) if len(calls) == 1 else scores.agg(*cols)

    lo, hi, above = S.bracket(Missing(), 20_000, 5_000)
    values = sorted((r.score for r in scores.collect()), reverse=True)
    assert len(calls) == 4 and lo <= values[4_999] <= hi and above == sum(v > hi for v in values) < 5_000
    lo, hi, above = S.bracket(scores, 20_000, 5_000)
    assert hi - lo < 200 and lo <= values[4_999] <= hi


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert S.resample(none, none).count() == 0
    rows = S.resample(some, none).collect()
    assert len(rows) == 2 and all(r.n_features == 0 and r.weight == 0 and r["rank"] is None for r in rows)


def test_gains():
    raw, target = np.array([0, 5, 1]), np.array([3, 0, 1])
    assert S.gains(raw, target).tolist() == [math.floor(1000 * math.log((t + 1) * 9 / ((s + 1) * 7))) for s, t in zip([0, 5, 1], [3, 0, 1])]
