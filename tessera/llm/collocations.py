"""Phrase collocation mining: mergeable Misra-Gries summaries, then exact counts.

A phrase is a run of 1 to ``ORDERS`` words of one piece of a text. The first
pass hashes every phrase of every text to a key of a fixed number of bits; a
task sends its keys, sorted and counted, to the hash partition that owns their
range. A partition merges what arrives into one Misra-Gries summary whose
capacity exceeds the partition's mass divided by the threshold, so its error
stays below the threshold and every phrase that reaches it survives (two phrases
of one key only make both survive). The second pass reads the texts again and
counts, as strings and exactly, the phrases whose keys survived. Scores come
from joins of the table of frequent phrases with itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import runs as R
from tessera.llm import words as W
from tessera.operators.relate import maybe_broadcast
from tessera.session import materialize

ORDERS = 5                  # words of the longest phrase
MIN_COUNT = 100             # occurrences of a phrase from which it is a candidate
COVER_PERCENT = 100         # a candidate goes if a longer one with it inside has this share of its count
TOP = 2000                  # phrases a language
SLACK = 8                   # a summary's capacity, times its mass divided by the threshold
BUFFER_KEYS = 1 << 22       # keys a task sorts and counts at once
ROUND_KEYS = 1 << 23        # surviving keys one round of the second pass looks for
HELD_PHRASES = 400_000      # different phrases a task counts before it sends them on
SALTS = 64                  # parts of a language whose best phrases are taken first
UNKNOWN = "und"
_BREAKS = ~R.table(b".,;:!?\x0a\x0b\x0c\x0d")
_INSIDE = R.table(b" \x09.,;:!?\x0a\x0b\x0c\x0d")
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)   # odd multipliers


# ---- phrases of a slice of texts

def phrases(w: W.Words, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first word, 64-bit hash) of all phrases of each length; ``seeds``: a hash of each row's language."""
    piece, h = R.pieces(w, _BREAKS), W.hashes(w)
    n, run = len(h), seeds[w.row]
    at = np.arange(n)
    for k in range(1, ORDERS + 1):
        if n >= k:
            run = (run[:n - k + 1] + h[k - 1:]) * _STEP
            whole = piece[:n - k + 1] == piece[k - 1:]
            yield k, at[:n - k + 1][whole], W.mix(run[whole])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[W.Words, np.ndarray, np.ndarray, list[str]]]:
    """(words, language code of each row, hash of each row's language, languages) from (lang, text) batches."""
    for b in batches:
        for at, texts in W.slices(b.column(1)):
            lang = b.column(0).slice(at, len(texts)).dictionary_encode()
            names = lang.dictionary.to_pylist()
            seeds = W.hashes(R.runs(pa.array(names, pa.large_string()), np.ones(256, bool))) if names else np.zeros(0, np.uint64)
            spread = np.zeros(len(names), np.uint64)
            spread[[i for i, x in enumerate(names) if x]] = seeds      # an empty name keeps 0
            codes = lang.indices.to_numpy()
            yield R.runs(texts, _INSIDE), codes, spread[codes], names


# ---- keys of a hash partition, packed

def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :data[0]] = low
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """The first of ascending keys, and the steps from each to the next."""
    return int(keys[0]), pack(np.diff(keys, prepend=keys[:1]))


def unpack_keys(first: int, data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) + np.uint64(first)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with their summed counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at) if len(at) else counts
    return keys[at], total.astype(np.int64)


def owner(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Hash partition of each key: equal ranges of keys, in order."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


_SENT = "part int, kind int, mass long, first long, keys binary, counts binary"


def _send(bits: int, parts: int, buffer_keys: int):
    """Map side of the first pass: rows of _SENT. A mass row (kind 0) and blocks of keys (kind 1) a partition."""
    def block(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = counted(keys)
        part = owner(keys, bits, parts)
        rows = []
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
            p, k, c = int(part[lo]), keys[lo:hi], n[lo:hi]
            rows.append((p, 0, int(c.sum()), 0, b"", b""))
            for chosen, once in ((c == 1, True), (c > 1, False)):       # no counts: one each
                if chosen.any():
                    rows.append((p, 1, 0, *pack_keys(k[chosen]), b"" if once else pack(c[chosen])))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                          pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())],
                                         names=["part", "kind", "mass", "first", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w, _, seeds, _ in slices(batches):
            for _, _, h in phrases(w, seeds):
                if len(h):
                    held.append(h >> np.uint64(64 - bits))
                    n += len(h)
            if n >= buffer_keys:
                yield from block(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from block(np.concatenate(held))

    return run


@dataclass
class Summary:
    """Misra-Gries summary of one hash partition: at most ``capacity`` keys. ``error`` bounds what any count lacks."""

    capacity: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    error: int = 0
    waiting: list = field(default_factory=list)
    n_waiting: int = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge the counts of other summaries or of texts."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.fold()

    def fold(self) -> None:
        """Sum what waits; beyond the capacity, lessen all counts by the largest that doesn't fit."""
        if self.waiting:
            self.keys, self.counts = counted(np.concatenate([self.keys, *[k for k, _ in self.waiting]]),
                                             np.concatenate([self.counts, *[c for _, c in self.waiting]]))
            self.waiting, self.n_waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            least = int(np.partition(self.counts, over - 1)[over - 1])
            stay = self.counts > least
            self.keys, self.counts = self.keys[stay], self.counts[stay] - least
            self.error += least

    def survivors(self, threshold: int) -> np.ndarray:
        """All keys that may have ``threshold`` or more."""
        self.fold()
        return self.keys[self.counts + self.error >= threshold]


def _merge(threshold: int, slack: int):
    """Reduce side: rows arrive by partition, masses first."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns])

    def out(part: int, s: Summary) -> Iterator[pa.RecordBatch]:
        keys = s.survivors(threshold)
        if len(keys):
            first, data = pack_keys(keys)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([first], pa.int64()),
                                              pa.array([data], pa.binary()), pa.array([s.error], pa.int64())],
                                             names=["part", "n", "first", "keys", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, s = None, 0, None
        for part, kind, m, first, keys, counts in rows(batches):
            if part != now:
                if s is not None:
                    yield from out(now, s)
                now, mass, s = part, 0, None
            if kind == 0:
                mass += m
                continue
            s = s or Summary(slack * (mass // threshold + 1))
            k = unpack_keys(first, keys)
            s.add(k, unpack(counts).astype(np.int64) if counts else np.ones(len(k), np.int64))
        if s is not None:
            yield from out(now, s)

    return run


def key_bits(total_bytes: int) -> int:
    """Bits of a key: sixteen times as many keys as bytes of text, so few phrases share one."""
    return min(60, max(36, int(total_bytes).bit_length() + 4))


def summaries(rows: DataFrame, bits: int, parts: int, threshold: int = MIN_COUNT, slack: int = SLACK,
              buffer_keys: int = BUFFER_KEYS) -> DataFrame:
    """(part, n, first, keys, error): the keys of all phrases of (lang, text) rows that may occur
    ``threshold`` times or more, one row a hash partition, written to the shared folder."""
    sent = rows.mapInArrow(_send(bits, parts, buffer_keys), _SENT)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(sent.repartition(n, "part").sortWithinPartitions("part", "kind")
                       .mapInArrow(_merge(threshold, slack), "part int, n long, first long, keys binary, error long"))


# ---- second pass

def _bitmap(keys: list[np.ndarray]) -> np.ndarray:
    """Bits set for a round's keys: 32 a key or more, a power of two, so about 1 of 32 other keys passes at most."""
    n = sum(map(len, keys))
    size = 1 << max(16, (32 * n).bit_length())
    bits = np.zeros(size // 8, np.uint8)
    for k in keys:
        at = spots(k, size)
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits


def spots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _count(sent, bits: int, lo: int, hi: int, with_words: bool, held_phrases: int):
    """Map side of the second pass: (lang, phrase, n) of the phrases whose key is below hi, from lo and in
    the bitmap; with the number of words of each language as the count of the empty phrase."""
    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            if c:
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                    pa.array(list(c.values()), pa.int64())], names=["lang", "phrase", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, counts = sent.value, {}
        for w, codes, seeds, names in slices(batches):
            text, lang_of = w.buf.tobytes(), codes[w.row] if len(codes) else np.zeros(0, np.int64)
            # A phrase is a stretch of the text where each gap is one blank; others are put together anew.
            gaps = np.ones(len(w.starts), np.int64)
            if len(gaps):
                gaps[:-1] = (w.starts[1:] - w.ends[:-1] != 1) | (w.buf[np.minimum(w.ends[:-1], len(w.buf) - 1)] != 32)
            odd = np.concatenate([[0], np.cumsum(gaps)])
            if with_words:
                for code, n in enumerate(np.bincount(lang_of, minlength=len(names))):
                    counts.setdefault(names[code], Counter())[b""] += int(n)
            for k, at, h in phrases(w, seeds):
                key = h >> np.uint64(64 - bits)
                spot = spots(key, 8 * len(have))
                hit = (have[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool) & (key >= lo) & (key < hi)
                at = at[hit]
                at = at[np.argsort(lang_of[at], kind="stable")]
                cuts = np.searchsorted(lang_of[at], np.arange(len(names) + 1))
                for name, a, b in zip(names, cuts, cuts[1:]):
                    if b > a:
                        found = map(text.__getitem__, map(slice, w.starts[at[a:b]].tolist(), w.ends[at[a:b] + k - 1].tolist()))
                        wide = odd[at[a:b] + k - 1] > odd[at[a:b]]
                        if wide.any():
                            found = (b" ".join(x.split()) if y else x for x, y in zip(found, wide.tolist()))
                        counts.setdefault(name, Counter()).update(found)
            if sum(map(len, counts.values())) >= held_phrases:
                yield from flush(counts)
        yield from flush(counts)

    return run


def frequent(docs: DataFrame, threshold: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text", slack: int = SLACK,
             buffer_keys: int = BUFFER_KEYS, round_keys: int = ROUND_KEYS, held_phrases: int = HELD_PHRASES) -> DataFrame:
    """(lang, phrase, n): exact counts of all phrases of 1 to ORDERS words that occur ``threshold`` times or
    more in a language, and, for the empty phrase, of all words of the language.

    A null language is ``und``, a null text empty; a language without words may have a row with 0 or none.
    Only ``round_keys`` surviving keys at a time reach the driver, as bits; more make more rounds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    bits = key_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = summaries(rows, bits, parts, threshold, slack, buffer_keys)
    rounds, room = [[]], round_keys
    for r in kept.select("part", "n").orderBy("part").collect():        # two numbers a hash partition
        if rounds[-1] and r["n"] > room:
            rounds.append([])
            room = round_keys
        rounds[-1].append(r["part"])
        room -= r["n"]
    edge = [0, *[-(-(p[0] << 32) // parts) << (bits - 32) for p in rounds[1:]], 1 << bits]
    out = None
    for i, own in enumerate(rounds):
        data = kept.where(F.col("part").between(own[0], own[-1])).select("first", "keys").collect() if own else []
        sent = spark.sparkContext.broadcast(_bitmap([unpack_keys(r["first"], r["keys"]) for r in data]))
        some = rows.mapInArrow(_count(sent, bits, edge[i], edge[i + 1], i == 0, held_phrases), "lang string, phrase string, n long") \
            .groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= threshold) | (F.col("phrase") == ""))
        some = materialize(some)
        sent.unpersist()
        out = some if out is None else out.unionByName(some)
    return out


# ---- scores

def _part(words, first, n):
    return F.array_join(F.slice(words, first, n), " ")


def collocations(counts: DataFrame, top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """The best phrases of each language from ``frequent``'s table: lang, rank, phrase, a, l, r, n, score.

    Each candidate of two or more words takes its lowest-scoring cut, the first of equal ones; a candidate
    inside a longer one with ``cover_percent`` of its count goes. Ties in rank go by count, then by phrase.
    Products have up to 38 digits: exact for counts below ten to the sixteenth.
    """
    words = F.split("phrase", " ")
    totals = counts.where("phrase = ''").select("lang", F.col("n").alias("words"))
    known = counts.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), words.alias("ws"), F.size(words).alias("size"))
    cuts = known.where("size > 1").select("lang", "phrase", "a", "ws", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", _part("ws", F.lit(1), F.col("k")).alias("left"),
                _part("ws", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(maybe_broadcast(totals, 10_000), "lang") \
        .withColumn("score", F.expr("(1000 * CAST(a AS DECIMAL(19, 0)) * CAST(words AS DECIMAL(19, 0)))"
                                    " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("words").alias("n"))).alias("b")) \
        .select("lang", "phrase", "b.score", "b.a", "b.l", "b.r", "b.n")
    # A longer phrase never occurs more often than one inside it, so the next longer candidates tell.
    inner = known.where("size > 2").select("lang", "a", F.explode(F.array(
        _part("ws", F.lit(1), F.col("size") - 1), _part("ws", F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(longer, ["lang", "phrase"], "left") \
        .where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = free.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of every language."""
    return collocations(frequent(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS c FROM (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda p: array_to_string(ws[p:p + size - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest(range(1, {ORDERS + 1})) AS size) WHERE len(ws) >= size)
  GROUP BY lang, size, phrase HAVING count(*) >= {MIN_COUNT}),
cuts AS (SELECT lang, phrase, size, c AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.size, a, k, l.c AS l, r.c AS r, n,
  (1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.c AS HUGEINT) * CAST(r.c AS HUGEINT)) AS score FROM cuts
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[k + 1:cuts.size], ' ') JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
free AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.size > b.size
  AND 100 * x.c >= {COVER_PERCENT} * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM free QUALIFY rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
