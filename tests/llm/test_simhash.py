"""SimHash components against all pairs on a small table."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fixtures_llm import SF_SMALL, docs_of  # noqa: F401
from tessera.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_match_plain():
    texts = ["a b c d e", "One  two\nthree", "", None, " \t ", "x", "A b C d é\x0bf g h " * 40, "w1\x1cw2 w3 w4 w5"]
    got = simhash.fingerprints(pa.array(texts))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{f:016x}" for f in fps], plain_components([r.doc_id for r in rows], fps))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 7])
def test_links_lose_no_component(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for x in base.tolist():
        for _ in range(6):
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long")
    edges = simhash.fingerprint_links(df, distance).collect()
    root = {np.uint64(x).astype(np.int64).item(): None for x in fps}
    from tessera.llm.graph import components
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} if edges else {}
    signed = list(root)
    want = plain_components(list(range(len(fps))), fps, distance)
    got = [found.get(s, s) for s in signed]
    pairs = {}
    for w, g in zip(want, got):
        pairs.setdefault(w, set()).add(g)
    assert all(len(v) == 1 for v in pairs.values()) and len(pairs) == len(set(got))


def test_edges_of_the_input(spark, docs_of):
    docs = docs_of([(5, "same words in this text"), (2, "same words in this text"), (5, "same words in this text"),
                    (9, None), (8, ""), (7, "  \n"), (None, "other words stand alone here now"), (None, None)])
    rows = simhash.near_duplicates(docs.withColumn("fp", docs.doc_id).withColumn("component_id", docs.doc_id)).collect()
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in rows)
    assert got == sorted([(5, 2), (5, 2), (2, 2), (9, 7), (8, 7), (7, 7), (-1, -1), (-1, 7)])
    assert len(rows) == 8
    assert simhash.near_duplicates(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 8)
