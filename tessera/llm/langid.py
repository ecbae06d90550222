"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent n-grams of letters (1 to
3, words padded with a blank) in rank order. A document's most frequent n-grams
are ranked likewise; its distance to a profile is the sum, over them, of how far
each is out of place, at most the profile's length for an n-gram not there. The
nearest profile is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm import words as W

PROFILE = 400             # n-grams of a language profile
RANKED = 300              # most frequent n-grams taken from a document
TRAIN_DOCS = 4000         # documents a language is learned from, about, at most
UNKNOWN = "und"
_BITS = 21                # of a code point


def _letters() -> np.ndarray:
    """Lower-case code point of each letter; 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: np.ndarray | None = None


def letters() -> np.ndarray:
    """The table of letters, made once a worker."""
    global _table
    if _table is None:
        _table = _letters()
    return _table


def code_points(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice and the row offsets among them."""
    buf, offsets = W.raw(texts)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return points, begins[offsets]


def grams(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) sorted by row: all 1- to 3-grams of letters, where
    a word's edge counts as one blank on either side, as 63-bit numbers."""
    points, offsets = code_points(texts)
    n = len(texts)
    # A blank before each text, and one after the last: grams never cross texts. Letters are
    # numbered from 2 within the slice, so that row and gram together make one sortable number.
    low = letters()[points]
    alphabet = np.flatnonzero(np.bincount(low)) if len(low) else np.zeros(0, np.int64)
    alphabet = alphabet[alphabet > 0]
    number = np.zeros(int(low.max()) + 1 if len(low) else 1, np.int64)
    number[alphabet] = np.arange(2, len(alphabet) + 2)
    code = np.zeros(len(points) + n + 1, np.int64)
    place = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    code[place] = number[low]
    row = np.zeros(len(code), np.int64)
    row[place] = np.repeat(np.arange(n), np.diff(offsets))
    mid = np.flatnonzero(code)
    size = len(alphabet) + 2
    # A blank is 1 inside a gram and 0 where a shorter gram has nothing.
    before, here, after = np.maximum(code[mid - 1], 1), code[mid], np.maximum(code[mid + 1], 1)
    base = row[mid] * size ** 3
    ends = after == 1
    key = np.concatenate([base + here, base + before * size + here, base[ends] + here[ends] * size + 1,
                          base + (before * size + here) * size + after])
    key.sort()
    if not len(key):
        return key, np.zeros(0, np.uint64), key
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    row, gram = np.divmod(key[first], size ** 3)
    point = np.concatenate([[0, 1], alphabet]).astype(np.uint64)
    x, y, z = point[gram // size ** 2], point[gram // size % size], point[gram % size]
    return row, (x << np.uint64(2 * _BITS)) | (y << np.uint64(_BITS)) | z, count


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank from 0) of each row's ``most`` most frequent grams; ties by gram."""
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    if not len(row):
        return row, gram, row
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    top = rank < most
    return row[top], gram[top], rank[top]


@dataclass
class Profiles:
    """Rank of each known gram in each language (``miss`` where it isn't)."""

    langs: list[str]
    grams: np.ndarray      # sorted
    ranks: np.ndarray      # gram x language
    miss: int


def distances(texts: pa.LargeStringArray, profiles: Profiles, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(total out-of-place distance by row and language, grams ranked by row)."""
    row, gram, rank = ranked(*grams(texts), most)
    n, k = len(texts), len(profiles.langs)
    at = np.minimum(np.searchsorted(profiles.grams, gram), max(len(profiles.grams) - 1, 0))
    known = profiles.grams[at] == gram if len(profiles.grams) else np.zeros(len(gram), bool)
    ranks = np.full((len(gram), k), -1, np.int64)
    ranks[known] = profiles.ranks[at[known]]
    apart = np.where(ranks >= 0, np.minimum(np.abs(ranks - rank[:, None]), profiles.miss), profiles.miss)
    out = np.zeros((n, k), np.int64)
    for j in range(k):
        out[:, j] = np.bincount(row, apart[:, j], n)
    return out, np.bincount(row, minlength=n)


def predict(texts: pa.Array, profiles: Profiles, most: int = RANKED) -> tuple[list[str], list[float]]:
    """Nearest language and 0..1 score (1 - distance over the largest one) of each text."""
    langs, scores = [], []
    for _, part in W.slices(texts, 1 << 20):
        d, n = distances(part, profiles, most)
        if not profiles.langs:
            langs += [UNKNOWN] * len(part)
            scores += [0.0] * len(part)
            continue
        best = np.argmin(d, axis=1)       # ties: the first language by name
        near = d[np.arange(len(part)), best]
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(n > 0, 1.0 - near / (n * profiles.miss), 0.0)
        langs += [profiles.langs[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist())]
        scores += s.tolist()
    return langs, scores


def learn(docs: DataFrame, length: int = PROFILE, most_docs: int = TRAIN_DOCS, lang_col: str = "lang",
          text_col: str = "text") -> Profiles:
    """Profiles of every non-null language of ``docs``.

    Each language is learned from its documents of lowest text hash, about
    ``most_docs`` of them at most; gram counts are summed on the cluster and only
    ``length`` grams a language reach the driver. Ties in a profile go by gram.
    """
    train = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")) \
        .where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = train.groupBy("lang").count().collect()
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, most_docs / r["count"])))]) if sizes else None
    if share is None:
        return Profiles([], np.zeros(0, np.uint64), np.zeros((0, 0), np.int64), length)
    unit = (F.xxhash64("text") / F.lit(2.0**64)) + 0.5
    some = train.where(unit < F.try_element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in W.slices(b.column(1), 1 << 20):
                row, gram, n = grams(part)
                names, lang = np.unique(np.array(b.column(0).slice(at, len(part)).to_pylist(), dtype=object), return_inverse=True)
                kinds, dense = np.unique(gram, return_inverse=True)
                total = np.bincount(lang[row] * len(kinds) + dense, n, len(names) * len(kinds)).astype(np.int64)
                have = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[i] for i in have // max(len(kinds), 1)], pa.string()),
                    pa.array(kinds[have % max(len(kinds), 1)].view(np.int64)), pa.array(total[have])], names=["lang", "gram", "n"])

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < length).select("lang", "gram", "rank").collect())
    langs = sorted({r["lang"] for r in top})
    known = np.array(sorted({r["gram"] for r in top}), np.int64).view(np.uint64)
    ranks = np.full((len(known), len(langs)), -1, np.int64)
    place = {g: i for i, g in enumerate(known.view(np.int64).tolist())}
    for r in top:
        ranks[place[r["gram"]], langs.index(r["lang"])] = r["rank"]
    return Profiles(langs, known, ranks, length)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (0 to 1).

    A null text or one without a letter is ``und`` with score 0. Columns of the
    same names are replaced, repeated rows stay, an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*own)
    place, sent = own.index(text_col), docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(b.column(place), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema, *added]))


def held_out_column(folds: int, fold: int, id_col: str = "doc_id"):
    """Whether the CRC-32 of the id as text has this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang") \
        .withColumn("held_out", held_out_column(4, 2))
    profiles = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
