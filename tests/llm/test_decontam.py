"""Containment search against exact containment of all pairs."""

import re

from fixtures_llm import SF_SMALL, docs_of  # noqa: F401
from tessera.llm import decontam

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def plain(docs, items, size=5, threshold=0.8):
    out = []
    for item_id, text in items:
        n = min(size, len(WORD.findall(text or "")))
        own = runs(text, n) if n else set()
        for doc_id, t in docs:
            if own:
                shared = len(own & runs(t, n))
                if shared >= threshold * len(own) - 1e-9:
                    out.append((doc_id, item_id, len(own), shared))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in df.collect()), key=str)


def test_table_against_all_pairs(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and found(decontam.contained(docs, items)) == want
    assert found(decontam.contained(docs, items, block_shingles=600)) == want     # several passes
    left = {r.doc_id for r in decontam.decontaminate(docs, items, block_shingles=600).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {w[0] for w in want}


def test_edges_of_the_input(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "x " * 3000 + passage.upper() + " y" * 3000), (1, passage), (None, passage), (2, None), (3, ""),
            (4, "lone tail"), (5, " ".join(f"p{i}" for i in range(50))), (6, " ".join(f"p{i}" for i in range(45))),
            (7, "w " * 40_000)]
    items = [(10, passage), (10, passage), (None, "lone\ttail"), (11, None), (12, ""), (13, "one two three four five"), (14, "w")]
    docs = docs_of(rows).withColumnRenamed("source", "item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontam.contained(docs, bench)) == plain(rows, items)
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.contained(docs, bench.limit(0)).count() == 0 and decontam.contained(docs_of([]), bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_minima_cannot_miss_small_items():
    import numpy as np
    h = np.arange(12, dtype=np.uint64)
    assert len(decontam._minima(18, h)) == 12 and len(decontam._minima(4, h)) <= 4
