"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

DataFrame and SQL functions only. A text's features are its words and word
pairs, hashed into ``buckets`` buckets (CRC-32 of each word; a pair mixes its
two). Two multinomials over the buckets are counted: one over all documents,
one over trusted documents. Both are shrunk towards no difference, so that a
rare bucket says little in a small corpus. A document's score is the sum over its features of
the log ratio of the two, in whole millionths so that it is the same whatever
the order of summation, divided by their number; it is kept from a fixed
threshold on. Simple rules (too few words, too much repetition) go first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SHRINK = 30.0               # corpus features added to each bucket at the corpus' own share of trusted ones
THRESHOLD = -0.12           # mean log ratio per feature
TRUSTED = 20_000            # trusted documents, at most; those of lowest CRC-32 of their id
PAIR = 65_599               # fixed multiplier of the word-pair hash
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
_SPACES = r"[\x20\x09-\x0D]+"


def _features(crc: Column, buckets: int) -> Column:
    """Buckets of an array of word hashes: each word's, then each pair's."""
    pairs = F.transform(F.slice(crc, 1, F.greatest(F.size(crc) - 1, F.lit(0))),
                        lambda x, i: ((x * PAIR + F.get(crc, i + 1) + 1) % buckets).cast("int"))
    return F.concat(F.transform(crc, lambda x: (x % buckets).cast("int")), pairs)


def _word_lists(docs: DataFrame, text_col: str, u: str = "_") -> DataFrame:
    """Adds text (null: empty), words and crc (hash of each word), their names begun by ``u``."""
    return (docs.withColumn(f"{u}text", F.coalesce(docs[text_col].cast("string"), F.lit("")))
            .withColumn(f"{u}words", F.filter(F.split(f"{u}text", _SPACES), lambda w: w != ""))
            .withColumn(f"{u}crc", F.transform(f"{u}words", lambda w: F.crc32(w))))


def _free_prefix(columns: list[str]) -> str:
    """Underscores that no column begins with."""
    return "_" * (1 + max([len(c) - len(c.lstrip("_")) for c in columns], default=0))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """doc_ids labelled quality 1, at most ``limit`` of them: lowest CRC-32 of the id first.

    Where there are many more, a bound on the CRC-32 that twice as many are
    expected below leaves only those to be sorted.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").dropDuplicates()
    crc, share = F.crc32(F.col("doc_id").cast("string")), 2 * limit / max(1, good.count())
    few = good.where(crc < F.lit(int(share * 2**32))) if share < 1 else good
    return few.orderBy(crc, "doc_id").limit(limit)


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            buckets: int = BUCKETS, shrink: float = SHRINK) -> list[int]:
    """Log ratio of each bucket in millionths. ``trusted``: few doc_ids (bounded by the caller).

    The counts cover every document; they are combined before the shuffle and at
    most ``buckets`` rows reach the driver. Without trusted documents all are 0.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")) \
        .join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("_good"))), "doc_id", "left")
    counts = (_word_lists(rows, "text").select(F.explode(_features(F.col("_crc"), buckets)).alias("b"), "_good")
              .groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good")).collect())
    raw, good = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not any(good):
        return [0] * buckets
    share = sum(good) / sum(raw)
    return [round(1e6 * math.log((g + shrink * share) / ((r + shrink) * share))) for g, r in zip(good, raw)]


def judge(docs: DataFrame, ratio: list[int], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), score (mean log ratio, double), base_failed and kept.

    A null or empty text has no words and fails. A document without features has
    score 0. Columns of the same names, in any case, are replaced and all others kept,
    whatever their names; rows are never dropped or merged, so repeated rows are judged
    alike. An empty table gives no rows.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in own]
    u = _free_prefix(keep)            # the working columns leave the caller's alone
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<bigint>")
    lines = F.filter(F.split(f"{u}text", "\n"), lambda x: F.length(F.regexp_replace(x, _SPACES, "")) > 0)
    d = (_word_lists(docs.select(*[docs[c] for c in keep]), text_col, u)
         .withColumn(f"{u}hash", F.transform(f"{u}words", lambda w: F.xxhash64(w)))
         .withColumn(f"{u}lines", lines))
    n = F.size(f"{u}words")
    d = d.withColumn(f"{u}runs", F.transform(
        F.slice(f"{u}hash", 1, F.greatest(n - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col(f"{u}hash"), i + k) for k in range(1, 5)])))
    # Windows that occur twice or more: equal neighbours once sorted. Most texts have none.
    d = d.withColumn(f"{u}sorted", F.when(
        F.size(F.array_distinct(f"{u}runs")) < F.size(f"{u}runs"),
        F.sort_array(F.transform(f"{u}runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn(f"{u}again", F.sort_array(F.transform(
        F.filter(f"{u}sorted", lambda x, i: (x.h == F.get(F.col(f"{u}sorted"), i - 1).h)
                 | (x.h == F.get(F.col(f"{u}sorted"), i + 1).h)), lambda x: x.i)))
    covered = F.aggregate(F.transform(f"{u}again", lambda p, i: F.least(
        F.lit(5), F.coalesce(F.get(F.col(f"{u}again"), i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn(f"{u}grams", _features(F.col(f"{u}crc"), len(ratio)))
    # One generated row each: no later filter is copied below the projections above, whose
    # expressions use one another several times over.
    d = d.select(*keep, F.inline(F.array(F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(f"{u}words", "")).cast("long").alias("word_chars"),
        (F.length(f"{u}text") - F.length(F.regexp_replace(f"{u}text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(f"{u}lines") - F.size(F.array_distinct(f"{u}lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.aggregate(f"{u}grams", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b)).alias(f"{u}sum"),
        F.size(f"{u}grams").cast("long").alias(f"{u}n")))))
    fails = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = F.col(f"{u}sum") >= F.lit(round(threshold * 1e6)) * F.col(f"{u}n")
    return d.select(*keep, *own[:5], F.coalesce(F.try_divide(F.col(f"{u}sum") / 1e6, F.col(f"{u}n")), F.lit(0.0)).alias("score"),
                    fails.alias("base_failed"), (~fails & good).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``judge`` with weights learned from all of ``docs`` and its trusted documents."""
    return judge(docs, weights(docs, trusted_ids(labels)), threshold=threshold)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all their columns) that ``quality`` keeps."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_whole"))
    return quality(whole, labels, threshold).where("kept").select("_whole.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CRC_TABLE = ("list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
              "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))")


def _oracle() -> str:
    crc = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), "
           "lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])))")
    octets = ("list_transform(range(octet_length(encode({x}))), "
              "lambda k: CAST('0x' || substr(hex(encode({x})), 2 * k + 1, 2) AS BIGINT))")
    return f"""WITH crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
keys AS (SELECT DISTINCT w AS x FROM w UNION SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1),
crc AS MATERIALIZED (SELECT x, {crc.format(bytes="octs")} AS h
  FROM (SELECT x, {octets.format(x="x")} AS octs, tab FROM keys, crc_table WHERE x IS NOT NULL)),
trusted AS (SELECT doc_id, 1 AS good FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
  JOIN crc ON x = CAST(doc_id AS VARCHAR) ORDER BY h, doc_id LIMIT {TRUSTED}),
wh AS MATERIALIZED (SELECT rid, p, h, lead(h) OVER (PARTITION BY rid ORDER BY p) AS h2 FROM w JOIN crc ON x = w),
grams AS MATERIALIZED (SELECT rid, h % {BUCKETS} AS b FROM wh
  UNION ALL SELECT rid, (h * {PAIR} + h2 + 1) % {BUCKETS} FROM wh WHERE h2 IS NOT NULL),
counts AS (SELECT b, count(*) AS r, count(good) AS g FROM grams JOIN d USING (rid) LEFT JOIN trusted USING (doc_id) GROUP BY b),
sums AS (SELECT CAST(sum(g) AS DOUBLE) / CAST(sum(r) AS DOUBLE) AS share FROM counts),
ratio AS (SELECT b, CASE WHEN share > 0 THEN
  CAST(round_even(1e6 * ln((g + {SHRINK} * share) / ((r + {SHRINK}) * share)), 0) AS BIGINT) ELSE 0 END AS v FROM counts, sums),
scored AS (SELECT rid, sum(v) AS s, count(*) AS k FROM grams JOIN ratio USING (b) GROUP BY rid),
runs AS (SELECT d.rid, p, array_to_string(ws[p:p + 4], ' ') AS run FROM d JOIN w USING (rid) WHERE p <= len(ws) - 4),
again AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, run) AS c FROM runs) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS c FROM again, (SELECT unnest(range(5)) AS k) GROUP BY rid),
base AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
all_rows AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, coalesce(s, 0) AS s, coalesce(k, 0) AS k
  FROM base LEFT JOIN covered USING (rid) LEFT JOIN scored USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND s >= {round(THRESHOLD * 1e6)} * k AS kept
FROM all_rows"""


QUERIES = {"op5_quality": op5_quality}
ORACLES = {"op5_quality": _oracle()}
