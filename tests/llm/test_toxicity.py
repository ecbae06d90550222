"""Lexicon matching against a plain search, the learned parts, and held-out accuracy."""

import math
import random
from collections import Counter

import pytest

from fixtures_llm import docs_of  # noqa: F401
from tessera.llm import toxicity as X

MODEL = X.Model({" idiot": 5.0, " idiotic ": 6.0, " trash ": 4.0}, frozenset({"trash can"}), 2.0, -3.0)


def plain_matches(folded, model):
    out = {}
    for i, c in enumerate(folded):
        if c == " ":
            best = max((w for t, w in model.weights.items() if folded.startswith(t, i)), default=0)
            if best and not any(p in model.exceptions for p in X.phrases(folded, i)):
                out[i] = best
    return out


@pytest.mark.parametrize("text", ["", None, "an idiot, idiots idiotic IDIOTIC!", "1D10T tr4$h", "іdіоt", "ｉｄｉｏｔ", "xidiot trashy trash",
                                  "the trash can is trash", "trash\ncan trash", "idiotidiot trash trash trash", "  trash  "])
def test_matches_equal_a_plain_search(text):
    folded = X.fold(text)
    assert X.matches(folded, MODEL) == plain_matches(folded, MODEL)


def test_disguises_fold_to_the_plain_word():
    for w in ("idiot", "IDIOT", "1d1ot", "іdіоt", "id!ot".replace("!", "1"), "ιdιοτ", "ｉｄｉｏｔ", "l̈diot"):
        assert X.fold(w) == X.fold("idiot")
    assert X.fold("clown") == X.fold("c1own") == X.fold("CL0WN")


def test_exceptions_and_length():
    assert X.signal("put it in the trash can", MODEL) == 0.0
    assert X.signal("trash", MODEL) > X.signal("trash and many other words that say nothing at all", MODEL) > 0
    assert 0 <= X.probability("idiot " * 1000, MODEL) <= 1 and X.probability(None, MODEL) == X.probability("", MODEL)


def test_learned_exception_and_copies(spark, docs_of):
    rows, labels, k = [], [], 0
    for i in range(60):
        rows.append((k, f"w{i} some clown b{i} text y{i} clown z{i}")); labels.append((k, 1)); k += 1
        if i < 8:
            rows.append((k, f"w{i} circus clown q{i} text v{i} plain")); labels.append((k, 0)); k += 1
        rows.append((k, f"c{i} just plain d{i} text")); labels.append((k, 0)); k += 1
    for _ in range(20):                                   # copies of one document make no term
        rows.append((k, "copied zebra sentence here")); labels.append((k, 1)); k += 1
    model = X.learn(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " ciown " in model.weights and "circus ciown" in model.exceptions
    assert not any("zebra" in t for t in model.weights)


def test_neighbours_are_whole_words():
    long = "a" * 200
    assert X.phrases(f" {long}  idiot   {long} ", len(long) + 2) == (f"{long} idiot", f"idiot {long}")
    assert X.phrases(" idiot ", 0) == ("^ idiot", "idiot $")
    assert X.phrases("   idiot   ", 2) == ("^ idiot", "idiot $")


def plain_learn(rows):
    """Lexicon and exceptions of (text, label) rows by plain search in each text."""
    n1 = sum(y for _, y in rows)
    n0, folded = len(rows) - n1, [(X.fold(t), y) for t, y in rows]
    terms = {t for f, y in folded if y for w in f.split() for t in X.terms_of(w)}
    weights = {}
    for t in terms:
        d1, d0 = (sum(t in f for f, y in folded if y == k) for k in (1, 0))
        near = set()
        for f, y in folded:
            if y and t in f:
                near.add(X.phrases(f, f.rindex(t)))
        w = math.log((d1 + 0.5) / (n1 + 1)) - math.log((d0 + 0.5) / (n0 + 1))
        if w >= X.MIN_WEIGHT and len(near) >= X.MIN_CONTEXTS:
            weights[t] = w
    model, ones, zeros = X.Model(weights), Counter(), Counter()
    for f, y in folded:
        (ones if y else zeros).update({p for at in plain_matches(f, model) for p in X.phrases(f, at)})
    return weights, {p for p, k in zeros.items() if k >= X.EXCEPTION_DOCS and k / n0 >= X.EXCEPTION_SHARE * (k / n0 + ones[p] / n1)}


def test_learned_parts_against_plain(spark, docs_of):
    """Also one label-1 document with hundreds of phrases: each counts against its exception."""
    rng = random.Random(3)
    texts = [(" ".join(rng.choice(["red", "blue", "green", "clown", "goat", f"n{rng.randrange(40)}"]) for _ in range(12)), 1) for _ in range(80)]
    texts += [(" ".join(rng.choice(["red", "blue", "green", "plain", f"n{rng.randrange(40)}"]) for _ in range(12)), 0) for _ in range(80)]
    texts += [(f"the circus clown number {i}", 0) for i in range(6)] + [(f"a zoo clown {i}", 0) for i in range(6)]
    texts += [(" ".join(f"q{i} clown" for i in range(200)) + " zoo clown", 1)] * 30
    docs = docs_of(list(enumerate(t for t, _ in texts)))
    model = X.learn(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    weights, exceptions = plain_learn(texts)
    assert model.weights == pytest.approx(weights) and model.exceptions == exceptions
    assert "circus ciown" in exceptions and "zoo ciown" not in exceptions and " goat " in weights


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = X.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert hit >= 0.9 * sum(r.toxic == 1 for r in rows)
    assert hit >= 0.9 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges_of_the_input(spark, docs_of):
    docs = docs_of([(1, "an idiot"), (1, "an idiot"), (None, "an idiot"), (2, None), (3, ""), (4, "word " * 100_000)])
    got = X.score(docs.withColumn("score", docs.lang), MODEL).collect()
    assert len(got) == 6 and sum(r.predicted for r in got) == 3
    nothing = X.learn(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int"))
    assert {r.score for r in X.score(docs, nothing).collect()} == {X.probability(None, nothing)}
    assert X.score(docs_of([]), nothing).count() == 0
    assert X.learn(docs_of([]), spark.createDataFrame([], "doc_id long, toxic int")) == X.Model()
