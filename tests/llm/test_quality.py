"""Quality rules against plain Python on small tables (the query itself has DuckDB SQL)."""

import math
import re
import zlib

import pytest

from fixtures_llm import docs_of  # noqa: F401
from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def grams(text, m):
    c = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
    return [x % m for x in c] + [(a * quality.PAIR + b + 1) % m for a, b in zip(c, c[1:])]


TEXTS = [None, "", " \n\t ", "one", "a b c d e " * 6, "ä ö ü é 😀 z # * $ % & | < >\n" * 3 + "fin",
         " ".join(f"w{i}" for i in range(300)), "x y z\nx y z\n\n \nq", "p q r s t u v w x p q r s t zz y1 y2 y3 y4 y5 y6 y7 y8 y9 y0",
         "same words again and again here now " * 200, "\x0b\x0cv1\rv2\x1cv3", "THE!! OF!! AND!! " * 5]


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "some row without an id")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(6, 1), (6, 1), (18, 1), (11, 0), (None, 1), (3, None)], "doc_id long, quality int")
    ratio = quality.weights(docs, quality.trusted_ids(labels), buckets=512)
    return docs, ratio, quality.judge(docs.withColumn("kept", docs.doc_id), ratio).collect()


def test_rules_match_plain(judged):
    docs, _, rows = judged
    assert len(rows) == 2 * len(TEXTS) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text), r.text


def test_ratio_matches_plain(judged):
    docs, ratio, rows = judged
    m, k = 512, quality.SHRINK
    raw, good = [0] * m, [0] * m
    for r in rows:
        for b in grams(r.text, m):
            raw[b] += 1
            good[b] += r.doc_id in (6, 18)
    share = sum(good) / sum(raw)
    want = [round(1e6 * math.log((g + k * share) / ((r + k) * share))) for g, r in zip(good, raw)]
    assert ratio == want
    for r in rows:
        g = grams(r.text, m)
        total = sum(ratio[b] for b in g)
        assert r.score == pytest.approx(total / 1e6 / len(g) if g else 0.0)
        assert r.kept == (not r.base_failed and total >= round(quality.THRESHOLD * 1e6) * len(g))


def test_main_path_is_native(spark, docs_of):
    docs = docs_of([(1, "a b c")])
    plan = quality.judge(docs, [0] * 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_columns_of_clashing_names_stay(spark, docs_of):
    docs = docs_of([(1, "a b c d e f g h i j k l"), (2, None)])
    names = ["_text", "_words", "_crc", "_hash", "_lines", "_runs", "_sorted", "_again", "_grams", "_sum", "_n", "___n", "p", "_whole", "_good"]
    more = docs.select("*", *[docs.doc_id.alias(c) for c in names], docs.doc_id.alias("Kept"))
    ratio = [1000] * 64
    got = {r.doc_id: r.asDict() for r in quality.judge(more, ratio).collect()}
    plain_rows = {r.doc_id: r.asDict() for r in quality.judge(docs, ratio).collect()}
    for i in (1, 2):
        assert got[i] == plain_rows[i] | {c: i for c in names}
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.kept(more, labels, threshold=-9.0).columns == more.columns


def test_empty_tables(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(docs_of([]), labels).count() == 0
    assert quality.quality(docs_of([(1, "only one here")]), labels).first().kept is False


def test_clean_documents_stay_and_junk_goes(spark):
    """At every size: nearly all quality-1 documents that pass the simple rules, and few quality-0 ones."""
    for sf, most in (("sf0.01", 0.5), ("sf0.1", 0.2)):
        d = f"/root/testdata/{sf}"
        labels = spark.read.parquet(f"{d}/labels.parquet")
        rows = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id") \
            .where("NOT base_failed").groupBy("quality").agg({"kept": "count", "doc_id": "count", "score": "avg"}).collect()
        kept = quality.kept(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id") \
            .groupBy("quality").count().collect()
        all_of, kept_of = {r.quality: r["count(kept)"] for r in rows}, {r["quality"]: r["count"] for r in kept}
        assert kept_of[1] >= 0.99 * all_of[1] and kept_of.get(0, 0) <= most * all_of[0]
