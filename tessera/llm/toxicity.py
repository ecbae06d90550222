"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lowers case and joins look-alikes (homoglyphs, digits and signs put for
letters), so that a disguised word equals its plain form. The
lexicon is learned from labelled documents: word beginnings whose document
frequency is far higher where the label is 1, in several different contexts. A
text's weights per word, without matches inside
exception phrases, become a probability by a fitted logistic curve.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.llm.langid import held_out_column

TRAIN_DOCS = 6000         # labelled documents of each class that the model is learned from, about, at most
BEGINNINGS = (4, 5, 6)    # letters of a word beginning; whole words are terms as well
MIN_WEIGHT = 1.5          # log ratio of document frequencies of a term
MIN_CONTEXTS = 4          # different neighbourhoods in label-1 documents that a term needs
EXCEPTION_DOCS, EXCEPTION_SHARE = 4, 0.8   # label-0 documents of an exception phrase, and their share

# Letters and signs that stand for each other (each row folds to its first letter).
LOOKALIKES = ["a4@аαа", "bвβ8", "cсϲ", "e3еєε€", "g9", "hнһ", "il1іιӏ¡", "jј", "kкκ", "mм", "nпη", "o0оοо", "pрρ",
              "s5$ѕ", "t7тτ", "uυ", "vν", "wшω", "xхχ", "yуγ", "z2"]


def _fold_table() -> dict[int, str]:
    out = {}
    for c in range(0x20, 0x250):
        ch = chr(c).lower()
        out[c] = ch if ch.isalnum() else " "
    for c in range(0xFF01, 0xFF5F):                       # full-width forms
        out[c] = chr(c - 0xFEE0).lower()
    for row in LOOKALIKES:
        for ch in row:
            out[ord(ch)] = row[0]
            out[ord(ch.upper()[0])] = row[0]
    for c in (9, 10, 11, 12, 13, 0xA0):
        out[c] = " "
    for c in range(0x300, 0x370):                         # accents on their own
        out[c] = ""
    return out


_FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Folded words, each with a blank before it, and one at the end."""
    return " " + (text or "").translate(_FOLD) + " "


def terms_of(word: str) -> list[str]:
    """Terms of a folded word: its beginnings, and the whole word closed by a blank."""
    return [" " + word[:n] for n in BEGINNINGS if len(word) > n] + [f" {word} "]


@dataclass
class Model:
    """Weights of terms, exception phrases, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 0.0
    offset: float = -1.0
    automaton: object = field(default=None, repr=False, compare=False)

    def ready(self):
        """The automaton, built once a worker."""
        if self.automaton is None and self.weights:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self.automaton.add_word(term, (len(term), w))
            self.automaton.make_automaton()
        return self.automaton

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}


def matches(folded: str, model: Model) -> dict[int, float]:
    """Weight of each matched word by the place of the blank before it: its best term's,
    unless the word is part of an exception phrase."""
    automaton = model.ready()
    if automaton is None:
        return {}
    best: dict[int, float] = {}
    for end, (n, w) in automaton.iter(folded):
        at = end - n + 1
        if w > best.get(at, 0.0):
            best[at] = w
    if best and model.exceptions:
        best = {at: w for at, w in best.items() if not any(p in model.exceptions for p in phrases(folded, at))}
    return best


def phrases(folded: str, at: int) -> tuple[str, str]:
    """The matched word with the whole word before, and with the whole word after."""
    end = folded.find(" ", at + 1)
    word = folded[at + 1: end]
    stop = at
    while stop > 0 and folded[stop - 1] == " ":
        stop -= 1
    left = folded[folded.rfind(" ", 0, stop) + 1: stop]
    begin = end
    while begin < len(folded) and folded[begin] == " ":
        begin += 1
    right = folded[begin: folded.find(" ", begin)] if begin < len(folded) else ""
    return f"{left or '^'} {word}", f"{word} {right or '$'}"


def signal(text: str | None, model: Model) -> float:
    """Weights per word, on a log scale."""
    folded = fold(text)
    found = matches(folded, model)
    return math.log1p(100.0 * sum(found.values()) / max(1, len(folded.split()))) if found else 0.0


def probability(text: str | None, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.offset + model.slope * signal(text, model)))))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve by Newton steps on a lightly penalised likelihood."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - np.array([1e-3, 1e-3]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(text, y) of labelled documents, about ``most`` of each class at most: lowest CRC-32 of the id first."""
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    bound = F.when(F.col("y") == 1, F.lit(min(1.0, most / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, most / max(1, n.get(0, 0)))))
    few = marks.where(F.crc32(F.reverse(F.col("doc_id").cast("string"))) < bound * 2.0**32)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Lexicon, exceptions and curve from a bounded sample of labelled documents.

    A term's weight is the log ratio of its document frequencies, MIN_WEIGHT at least; it needs
    MIN_CONTEXTS different neighbourhoods in label-1 documents. Terms, neighbourhoods and phrases
    are counted on the cluster, all of them; the terms and phrases that pass, and one number a
    sampled document, reach the driver: the sample bounds them. Without documents of both labels
    nothing is learned and every score is the same.
    """
    rows = sample(docs, labels, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, zeros = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {t for w in set(fold(text).split()) for t in terms_of(w)}
                (ones if y else zeros).update(own)
        terms = sorted(set(ones) | set(zeros))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([ones[t] for t in terms], pa.int64()),
                                          pa.array([zeros[t] for t in terms], pa.int64())], names=["term", "d1", "d0"])

    size = rows.groupBy().agg(F.sum("y").alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = int(size["n1"] or 0), int(size["n"]) - int(size["n1"] or 0)
    if not n1 or not n0:
        return Model()
    ratio = F.log((F.col("d1") + 0.5) / (n1 + 1.0)) - F.log((F.col("d0") + 0.5) / (n0 + 1.0))
    top = (rows.mapInArrow(count, "term string, d1 long, d0 long").groupBy("term").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))
           .withColumn("w", ratio).where((F.col("d1") >= MIN_CONTEXTS) & (F.col("w") >= MIN_WEIGHT)).select("term", "w").collect())
    candidates = Model({r["term"]: r["w"] for r in sorted(top)})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, context) of each candidate that a label-1 document holds, one context for each term."""
        automaton = candidates.ready()
        for b in batches:
            terms, contexts = [], []
            for f in map(fold, b.column(0).to_pylist()):
                got = {f[e - n + 1: e + 1]: " ".join(phrases(f, e - n + 1)) for e, (n, _) in automaton.iter(f)} if automaton else {}
                terms += got.keys()
                contexts += got.values()
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(contexts, pa.string())], names=["term", "context"])

    # Copies of one document are one context, and make no term.
    several = (rows.where("y = 1").mapInArrow(found, "term string, context string").distinct().groupBy("term").count()
               .where(F.col("count") >= MIN_CONTEXTS).select("term").collect())
    plain = Model({t: candidates.weights[t] for t in sorted(r["term"] for r in several)})

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ps = [], []
            for text in b.column(0).to_pylist():
                folded = fold(text)
                got = matches(folded, plain)
                ps.append(sorted({p for at in got for p in phrases(folded, at)}))
                xs.append(signal(text, plain))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(xs, pa.float64()), pa.array(ps, pa.list_(pa.string()))],
                                             names=["y", "x", "near"])

    seen = rows.mapInArrow(around, "y int, x double, near array<string>")
    k0, k1 = F.col("k0"), F.col("k1")
    mild = (seen.select("y", F.explode("near").alias("p")).groupBy("p").agg(F.count_if(F.col("y") == 0).alias("k0"), F.count_if(F.col("y") == 1).alias("k1"))
            .where((k0 >= EXCEPTION_DOCS) & (k0 / n0 >= EXCEPTION_SHARE * (k0 / n0 + k1 / n1))).select("p").collect())
    curve = sorted((r["x"], r["y"]) for r in seen.select("y", "x").collect())          # one order, whatever the tasks
    slope, offset = fit_curve(np.array([x for x, _ in curve]), np.array([y for _, y in curve], float))
    return Model(plain.weights, frozenset(r["p"] for r in mild), slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1) and predicted (1 from 0.5 on).

    A null, empty or unmatched text has the curve's value at no match. Columns of
    the same names are replaced, repeated rows stay, an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*own)
    place, sent = own.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [probability(t, sent.value) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())],
                                             names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labelled documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out_column(5, 0))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic") \
        .where(~held_out_column(5, 0))
    return score(docs, learn(docs.where(~F.col("held_out")), labels)).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
