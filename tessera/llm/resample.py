"""Target-distribution importance resampling: hashed n-gram gains, then a random draw of the best.

Features are words and word pairs, hashed into buckets. One pass counts the
buckets of the raw documents, one those of the target; a bucket's gain is the
log ratio of its two smoothed shares, and a document's weight the mean gain of
its features, scored in arrays. Weight plus Gumbel noise from the document's id
makes the draw: the highest scores win. The cutoff is found without sorting
all: a quantile sketch brackets it, exact counts outside the bracket validate
or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import runs as R
from tessera.llm import words as W
from tessera.session import materialize

BUCKETS = 10_000
SHARE_PERCENT = 25          # of the documents that may be drawn
MIN_WORDS = 20              # a document with fewer is never drawn
SEED = 7
ACCURACY = 10_000           # of the quantile sketch; the bracket is about 4 / ACCURACY of the documents wide
_INSIDE = R.table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LONG = 64                  # bytes; longer words take zlib


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def _steps() -> list[np.ndarray]:
    """For n of 0 to _LONG: what n zero bytes make of a CRC state, by each of its four bytes."""
    tables = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
    for _ in range(_LONG):
        tables.append(_TABLE[tables[-1] & np.uint32(255)] ^ (tables[-1] >> np.uint32(8)))
    return tables


_ZEROS = np.stack(_steps())


def _continued(state: np.ndarray, w: W.Words, at: np.ndarray) -> np.ndarray:
    """CRC-32 state of each run of bytes after the words ``at``, from the state before each."""
    lens = (w.ends - w.starts)[at]
    order = np.argsort(-np.minimum(lens, _LONG + 1), kind="stable")
    lens, state, starts = lens[order], state[order], w.starts[at][order]
    n_long = int(np.searchsorted(-lens, -_LONG))
    for i in range(n_long):                                         # zlib keeps the inverted state
        state[i] = zlib.crc32(w.buf[starts[i]:starts[i] + lens[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    upto = len(lens)
    for k in range(int(lens[n_long]) if n_long < len(lens) else 0):
        upto = int(np.searchsorted(-lens, -k))                      # words longer than k
        some = state[n_long:upto]
        state[n_long:upto] = _TABLE[(some ^ w.buf[starts[n_long:upto] + k]) & np.uint32(255)] ^ (some >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(w: W.Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of consecutive words of a row.

    The CRC-32 of a pair joins those of its two parts: the first part's state moved over
    as many zero bytes as the second is long, by table, with the second's.
    """
    n, full = len(w.starts), np.uint32(0xFFFFFFFF)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    crc = _continued(np.full(n, full), w, at) ^ full
    pair = at[:-1][w.row[1:] == w.row[:-1]]
    state = crc[pair] ^ full
    state = _TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))     # the blank
    lens = (w.ends - w.starts)[pair + 1]
    both, short = np.empty(len(pair), np.uint32), lens <= _LONG
    s, k = state[short] ^ full, lens[short]
    moved = _ZEROS[k, 0, s & 255] ^ _ZEROS[k, 1, s >> 8 & 255] ^ _ZEROS[k, 2, s >> 16 & 255] ^ _ZEROS[k, 3, s >> 24]
    both[short] = moved ^ crc[pair[short] + 1]
    if not short.all():
        both[~short] = _continued(state[~short], w, pair[~short] + 1) ^ full
    return np.concatenate([w.row, w.row[pair]]), np.concatenate([crc, both]).astype(np.int64) % buckets


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows: summed in each task, then by bucket; ``buckets`` numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in W.slices(b.column(0)):
                total += np.bincount(features(R.runs(texts, _INSIDE), buckets)[1], minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select(rows[text_col].cast("string").alias("text")).mapInArrow(count, "b int, n long") \
            .groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share of the target and of the raw features, floored."""
    s_all, t_all, m = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus n_words, n_features and weight (floored mean gain of the features, 0 without).

    A null text has none. Columns of the same names are replaced; rows are never dropped or merged.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_features", "weight")]
    docs = docs.select(*[docs[c] for c in own])
    place, sent = own.index(text_col), docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for at, texts in W.slices(b.column(place).cast(pa.large_string())):
                w = R.runs(texts, _INSIDE)
                row, bucket = features(w, len(sent.value))
                n_words[at:at + len(texts)] = np.diff(w.first)
                n[at:at + len(texts)] = np.bincount(row, minlength=len(texts))
                # A sum of whole numbers: exact in doubles below 2^53.
                total[at:at + len(texts)] = np.bincount(row, sent.value[bucket], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=[*b.schema.names, "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, StructType([*docs.schema, *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]]))


def noise(id_col: str | Column = "doc_id", seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable from the id's SHA-256, floored; a null id counts as an empty one."""
    text = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# ---- the draw

def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with place (0, 1, ...) in ``order``, whose keys differ: sorted by ranges, numbered in each
    partition, and moved by the rows of the partitions before, of which the driver gets one number each."""
    mask = (1 << 33) - 1
    sorted_rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                              .withColumn("place", F.monotonically_increasing_id()))
    sizes = sorted_rows.groupBy(F.shiftright("place", 33).alias("p")).count().orderBy("p").collect()
    before, upto = [], 0
    for r in sizes:
        before.append((r["p"], upto))
        upto += r["count"]
    offsets = sorted_rows.sparkSession.createDataFrame(before, "_p long, _before long")
    return sorted_rows.withColumn("_p", F.shiftright("place", 33)).join(F.broadcast(offsets), "_p") \
        .withColumn("place", F.col("_before") + F.col("place").bitwiseAND(F.lit(mask))).drop("_p", "_before")


def bracket(scores: DataFrame, n: int, k: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(lowest, highest, rows above the highest) of a range of scores that holds the k-th highest of the ``n``
    rows. A sketch proposes it; exact counts outside tell whether it holds, else it is widened."""
    part, width = 1 - k / n, 2 / accuracy
    while True:
        lo, hi = scores.agg(F.percentile_approx("score", [max(0.0, part - width), min(1.0, part + width)], accuracy)).first()[0]
        if width >= 1:
            lo, hi = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < k <= above + inside:
            return lo, hi, above
        width *= 8


def draw(scored: DataFrame, eligible: Column, share_percent: int = SHARE_PERCENT, id_col: str = "doc_id",
         accuracy: int = ACCURACY) -> DataFrame:
    """All columns of ``scored`` plus rank: 1, 2, ... for the floor(share_percent / 100 * N) highest scores of the
    N rows that are ``eligible``, null for the rest.

    Ties go to the smaller id, a null id last; rows alike in both keep an order of their own, so of repeated
    rows just as many are drawn as there is room for. ``scored`` needs a column score. A column rank is replaced.
    """
    own = [c for c in scored.columns if c != "rank"]
    # Written once, so that row numbers and ranges mean the same rows in every later job.
    rows = materialize(scored.select(F.struct(*[scored[c] for c in own]).alias("own"), scored["score"].alias("score"),
                                     scored[id_col].alias("id"), eligible.alias("eligible"))
                       .withColumn("row", F.monotonically_increasing_id()))
    may = rows.where("eligible")
    n = may.count()
    k = share_percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    nothing = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select("own.*", nothing)
    lo, hi, above = bracket(may.select("score"), n, k, accuracy)
    cut = _placed(may.where(F.col("score").between(lo, hi)).select("score", "id", "row"), order) \
        .where(F.col("place") == k - above - 1).first()
    score, row_id, row = F.col("score"), F.col("id"), F.col("row")
    same = row_id.eqNullSafe(F.lit(cut["id"]))
    earlier = row_id < F.lit(cut["id"]) if cut["id"] is not None else row_id.isNotNull()
    drawn = F.col("eligible") & ((score > cut["score"]) | (score == cut["score"]) & (
        F.coalesce(earlier, F.lit(False)) | same & (row <= cut["row"])))
    ranked = _placed(rows.where(drawn).select("own", "score", "id", "row"), order)
    return ranked.select("own.*", (F.col("place") + 1).alias("rank")) \
        .unionByName(rows.where(~F.coalesce(drawn, F.lit(False))).select("own.*", nothing))


def resample(docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus n_words, n_features, weight, score and rank (null: not drawn).

    Weights are learned from all texts of ``docs`` and ``target`` (column text in both). An empty target gives
    gains by the raw counts alone; an empty table of documents no rows.
    """
    own = [c for c in docs.columns if c not in ("score", "rank")]
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weigh(docs.select(*[docs[c] for c in own]), gain).withColumn("score", F.col("weight") + noise(id_col, seed))
    return draw(scored, F.col("n_words") >= min_words, share_percent, id_col)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's distribution."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain).select("doc_id", "n_words", "n_features", "weight").withColumn("score", F.col("weight") + noise())
    return draw(scored, F.col("n_words") >= MIN_WORDS).select("doc_id", "n_features", "weight", "score", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _oracle() -> str:
    table = ("list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
             "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))")
    octets = ("list_transform(range(octet_length(encode(x))), "
              "lambda k: CAST('0x' || substr(hex(encode(x)), 2 * k + 1, 2) AS BIGINT))")
    crc = (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), "
           "lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])))")
    return f"""WITH crc_table AS MATERIALIZED (SELECT {table} AS tab),
texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, raw, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT true AS raw, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark)),
features AS MATERIALIZED (SELECT rid, raw, unnest(ws) AS x FROM texts UNION ALL
  SELECT rid, raw, unnest(list_transform(range(1, len(ws)), lambda p: ws[p] || ' ' || ws[p + 1])) FROM texts WHERE len(ws) > 1),
hashed AS MATERIALIZED (SELECT x, {crc} % {BUCKETS} AS b FROM (SELECT DISTINCT x FROM features), crc_table),
counts AS (SELECT b, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM features JOIN hashed USING (x) GROUP BY b),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + {BUCKETS})
  / ((CAST(s AS DOUBLE) + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS g FROM counts, sums),
weights AS (SELECT rid, count(*) AS k, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS w
  FROM features JOIN hashed USING (x) JOIN gain USING (b) WHERE raw GROUP BY rid),
scored AS (SELECT rid, doc_id, len(ws) >= {MIN_WORDS} AS may, coalesce(k, 0) AS n_features, coalesce(w, 0) AS weight,
  coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (rid) WHERE raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN may AND place <= {SHARE_PERCENT} * n // 100 THEN place END AS rank FROM ranked"""


QUERIES = {"op13_resampling": op13_resampling}
ORACLES = {"op13_resampling": _oracle()}
