"""Sentence spans against a plain implementation on small tables."""

import random
import re

import pyarrow as pa

from fixtures_llm import SF_SMALL, docs_of  # noqa: F401
from tessera.llm import sentences as S
from tessera.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    """[(words, start)] of the sentences."""
    out, new = [], True
    found = list(WORD.finditer(text or ""))
    for k, m in enumerate(found):
        if new:
            out.append(([], m.start()))
        out[-1][0].append(m[0].translate(LOWER))
        new = m[0][-1] in ".!?" or k + 1 < len(found) and "\n" in text[m.end():found[k + 1].start()]
    return out


def word_hash(word, known={}):
    if word not in known:
        known[word] = int(W.hashes(W.words(pa.array([word], pa.large_string())))[0])
    return known[word]


def ranges(text):
    """{(kind, first word, end)}: runs of whole sentences on from and back from each (kind 0, with and without
    line ends as bounds), and spans between cuts that hold no such run (kind 1)."""
    out, ws = set(), [m[0].translate(LOWER) for m in WORD.finditer(text)]
    for by_line in (True, False):
        bounds = [0]
        for s, _ in split(text if by_line else text.replace("\n", " ")):
            bounds.append(bounds[-1] + len(s))
        ends = {}
        for i in range(len(bounds) - 1):
            alone = bounds[i + 1] - bounds[i] >= S.LONE
            on = [j for j in range(i + 1, len(bounds)) if alone or j - i >= S.SENTENCES and bounds[j] - bounds[i] >= S.WORDS]
            back = [j for j in range(i, -1, -1) if alone or i + 1 - j >= S.SENTENCES and bounds[i + 1] - bounds[j] >= S.WORDS]
            if on:
                ends[bounds[i]] = bounds[on[0]]
                out.add((0, bounds[i], bounds[on[0]]))
            if back:
                out.add((0, bounds[back[0]], bounds[i + 1]))
    h = [word_hash(x) for x in ws]
    cut = sorted({max(range(i, i + S.CUT), key=lambda k: (-h[k], k)) for i in range(len(ws) - S.CUT + 1)})
    for c in cut:
        to = next((x for x in cut if x >= c + S.PASSAGE), None)
        first = next((x for x in bounds[:-1] if x > c), None)          # bounds without line ends
        if to is not None and not (first in ends and ends[first] <= to):
            out.add((1, c, to))
    return ws, out


def plain(rows):
    """{(id, text): (cleaned, sentences, removed)} of (id, text) rows."""
    keyed = sorted({(d is None, d or 0, t or "") for d, t in rows})
    firsts, own = {}, {}
    for doc in keyed:
        ws, found = ranges(doc[2])
        own[doc] = [((kind, tuple(ws[a:b])), a, b) for kind, a, b in found]
        for key, a, _ in own[doc]:
            firsts[key] = min(firsts.get(key, (doc, a)), (doc, a))
    out = {}
    for doc in keyed:
        gone, t = set(), doc[2]
        for key, a, b in own[doc]:
            first, at = firsts[key]
            if first != doc or a != at and (key[0] == 0 or a >= at + b - a):
                gone |= set(range(a, b))
        starts = [m.start() for m in WORD.finditer(t)]
        cuts = [0, *starts[1:], len(t)]
        s, k, touched = split(t), 0, 0
        for words, _ in s:
            touched += bool(gone & set(range(k, k + len(words))))
            k += len(words)
        out[(None if doc[0] else doc[1], t)] = ("".join(t[x:y] for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if i not in gone)
                                                if starts else t, len(s), touched)
    return out


def test_table_against_plain(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = S.op7_sentence_spans(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.text, r.n_sentences, r.n_removed) == want[(r.doc_id, texts[r.doc_id] or "")], r.doc_id
    assert any(r.n_removed for r in rows)


PASSAGE = "The quick brown fox jumps over the lazy dog tonight. Then a grey cat sat on its mat and slept.\nNo one saw them go home at all! " \
          "It was a very long and quiet night out there."


def test_passages_and_edges(spark, docs_of):
    own = [f"Unique {w} words fill this sentence number {w} here. Another {w} one follows right after it {w} now." for w in "abcdefg"]
    rows = [(1, own[0] + " " + PASSAGE + " " + own[1]), (2, PASSAGE.upper().replace("\n", " \n ") + "\n" + own[2]),
            (3, own[3] + "\n" + PASSAGE), (3, own[3] + "\n" + PASSAGE), (4, None), (5, ""), (6, " \n "), (7, own[4] + " " + own[4]),
            (None, PASSAGE), (8, "Short one. Tiny. A. B."), (9, "Short one. Tiny. A. B."), (10, "long " * 50 + "end."), (11, "long " * 50 + "end.")]
    docs = docs_of(rows)
    got = S.remove_repeats(docs.withColumn("n_removed", docs.lang).withColumn("k", docs.doc_id)).collect()
    want = plain(rows)
    texts = {(d, t) for d, t in rows}
    assert len(got) == len(rows)
    seen = sorted(((r.doc_id, r.text or "", r.n_sentences, r.n_removed) for r in got), key=str)
    assert seen == sorted(((d, *want[(d, t or "")]) for d, t in rows), key=str)
    by = {r.doc_id: r for r in got}
    assert by[4].text is None and by[1].n_removed == 0 and by[9].n_removed == 0 and by[11].text == ""
    assert "quick" not in by[2].text.lower() and "quick" not in by[3].text and by[None].text == "" and len(texts) == 12
    assert S.remove_repeats(docs_of([])).count() == 0


def test_partitions_do_not_matter(spark, docs_of):
    rows = [(i, f"{PASSAGE} Own tail {i} here with some more words. And {i} the end of it all.") for i in range(40)]
    a, b = (sorted(map(tuple, S.remove_repeats(docs_of(rows).repartition(n)).select("doc_id", "text").collect())) for n in (1, 7))
    assert a == b and sum("quick" in t for _, t in a) == 1


def windows(text, size=51):
    words = [m[0].translate(LOWER) for m in WORD.finditer(text or "")]
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def test_no_long_passage_stays(spark, docs_of):
    """No 51 words in a row of an earlier document stay, wherever the passage begins and ends in its sentences."""
    rng = random.Random(5)

    def stretch(n, stop):
        return " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) + ("." if rng.random() < stop else "") for _ in range(n))
    rows = []
    for i, stop in enumerate([0, 0, 0, 0.01, 0.02, 0.05, 0.1, 0.3] * 6):
        shared = stretch(rng.choice([51, 51, 52, 60, 90, 200]), stop)
        rows += [(2 * i + k, f"{stretch(rng.randrange(60), stop)} {shared} {stretch(rng.randrange(60), stop)}") for k in (0, 1)]
    tail = "one " + " ".join(f"w{i}" for i in range(44)) + " end. And a last short sentence."
    rows += [(1000, "Own a. " + tail + " Own words b."), (1001, "Own c. " + tail + " Own words d.")]
    few = "Some dozen words or a little more make up this first sentence here. It ended. So it did."
    rows += [(1002, few + " Own words follow this passage here in e."), (1003, few + " Other words follow that passage there in f.")]
    lines = stretch(80, 0.1)
    rows += [(1006, lines.replace(" ", "\n")), (1007, lines)]
    rows += [(1004, "word " * 51), (1005, " ".join(f"z{i}" for i in range(26)) + " tail")]
    got = {r.doc_id: r for r in S.remove_repeats(docs_of(rows).repartition(5)).collect()}
    seen = set()
    for d, t in sorted(rows):
        assert not seen & set(windows(got[d].text)), d
        seen |= set(windows(t))
        if d % 2 == 0 or d == 1005:
            assert got[d].text == t and got[d].n_removed == 0
    assert got[1001].text == "Own c. Own words d." and got[1003].text == "Other words follow that passage there in f."
    assert sum(got[2 * i + 1].text != rows[2 * i + 1][1] for i in range(48)) == 48
