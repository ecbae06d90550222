"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are all words, the start and the end of a text. A context of up to
ORDER symbols that the training documents hold STATE times or more is a
candidate state. It is retained if its next-symbol distribution diverges from
that of its longest retained suffix: the training text must gain GAIN nats or
more under leave-one-out counts. A next symbol seen LEAST times or more in a
state has its own count; the mass of rarer ones and PRIOR tokens go to the
suffix's distribution, down to the root, the smoothed word frequency. Each token
is scored in the longest retained state that is a suffix of what comes before.

Counts, states and transitions are tables that grow with the documents; only
the bounded filters and the HEAD rows named below pass through the driver. A sequence of symbols (a gram) is a 64-bit
key made of the keys of its two shorter parts. A gram that occurs twice has
parts that do, so a filter of repeated pairs, a bitmap of bounded size, spares
most of the others their shuffle; what it lets through is counted exactly. One
length of grams is shuffled at a time, a task's counts for a range of keys as one
packed row, and tables that no later step reads go.
For scoring, a chunk of documents asks the table for the grams that it holds, but
for the HEAD most frequent ones, which every task has, and the words of training
documents that a filter of repeated words doesn't know, which occur once. What it
asks a range of keys, and the answers in the same order, are one packed row each.
A third of the chunks is scored at a time, so that the answers to the others needn't be kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.session import checkpoint_dir

ORDER = 2                 # symbols in a context, at most
LEAST = 2                 # occurrences that give a next symbol its own count
STATE = 2                 # occurrences that make a context a candidate
GAIN = 10.0               # nats
PRIOR = 1.0               # tokens left to the suffix's distribution in every state
CHUNK_BYTES = 16 << 20    # text that is scored together
COUNTED = 1 << 20         # keys that a task sums at once before they are shuffled
SUMMED = 1 << 20          # occurrences of grams whose counts are summed together, about
RANGE = 1 << 19           # rows of the tree that are looked up together, about
PORTIONS = 3              # parts of the chunks that are looked up and scored one after the other
WHOLE = 16                # chunks, at most, that are one portion
HEAD = 1 << 20            # rows of the tree that every task has, at most
FILTER_BITS = 1 << 30     # size of a filter, at most (128 MB); 16 bits a key below that
START, END = np.uint64(0x5BF0A8B145769231), np.uint64(0x27D4EB2F165667C5)      # keys of a text's two ends
_A, _B = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a gram from those of the gram without its last and without its first symbol."""
    return W.mix(a * _A + W.mix(b + _B))


def sequences(w: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, symbols left in the row) of every symbol: each text's start, words and end."""
    rows, n = len(w.first) - 1, np.diff(w.first)
    key = np.empty(len(h) + 2 * rows, np.uint64)
    first = w.first[:-1] + 2 * np.arange(rows)
    last = first + n + 1
    key[np.arange(len(h)) + 2 * w.row + 1] = h
    key[first], key[last] = START, END
    row = np.repeat(np.arange(rows, dtype=np.int32), n + 2)
    return key, row, (last[row] - np.arange(len(key))).astype(np.int32)


def grams(key: np.ndarray, length: int) -> list[np.ndarray]:
    """Keys of the grams of 1 to ``length`` symbols that begin at each place (those past a row's end mean nothing)."""
    out = [key]
    for _ in range(1, length):
        g = out[-1].copy()
        g[:-1] = join_keys(out[-1][:-1], out[-1][1:])
        out.append(g)
    return out


class Filter:
    """A bitmap of two bits a key: tells that a key is absent, or may be present."""

    def __init__(self, keys: DataFrame, limit: int = FILTER_BITS):
        """Of the table's column ``key``; at most ``limit`` bits reach the driver and the tasks."""
        n = keys.count()
        self.bits = min(limit, max(1 << 20, 1 << (16 * n).bit_length()))
        places = F.expr(f"array((key & {self.bits - 1}L) + 1, (shiftrightunsigned(key, 34) & {self.bits - 1}L) + 1)")
        parts = keys.select(F.explode(places).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("b")) \
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("m")).collect()
        self.map = np.zeros(self.bits >> 3, np.uint8)
        for r in parts:
            at = (r["b"] - 1) * len(r["m"])
            self.map[at: at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)

    def has(self, key: np.ndarray) -> np.ndarray:
        def at(x: np.ndarray) -> np.ndarray:
            x = (x & np.uint64(self.bits - 1)).astype(np.int64)
            return (self.map[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0

        out = at(key)
        may = np.flatnonzero(out)
        out[may] = at(key[may] >> np.uint64(34))
        return out


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files go as soon as the table made of them is written (restored at the end)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Tables:
    """Tables in a folder of their own in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/suffixtree-{uuid.uuid4().hex}"

    def written(self, name: str, df: DataFrame) -> DataFrame:
        """The table, written and read again."""
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """These tables go; nothing later reads them."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _head(model: DataFrame, most: int) -> tuple[int, pa.Table]:
    """Least count, and rows from it on, sorted by key: as many whole counts as make ``most`` rows or fewer."""
    by = model.groupBy(F.least(F.col("n"), F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, rows = (1 << 20) + 1, 0
    for r in by:
        rows += r["count"]
        if rows > most:
            break
        least = r["n"]
    table = model.where(F.col("n") >= least).toArrow()
    return least, table


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, n, p and left of rows of the tree, by key; an empty p or left is NaN."""
    def column(name: str) -> np.ndarray:
        c = table.column(name)
        return np.concatenate([np.zeros(0, np.int64 if name in ("key", "n") else np.float64),
                               *[np.asarray(x.fill_null(0 if name in ("key", "n") else np.nan)) for x in c.chunks]])
    key = column("key").view(np.uint64)
    by = np.argsort(key)
    return key[by], column("n")[by], column("p")[by], column("left")[by]


def _places(known: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted known ones; their number if it isn't there."""
    if not len(known):
        return np.zeros(len(g), np.int64)
    i = np.minimum(np.searchsorted(known, g), len(known) - 1)
    return np.where(known[i] == g, i, len(known))


class _Index:
    """Places of keys among sorted, evenly spread ones: a table tells where the keys with some highest bits begin."""

    def __init__(self, known: np.ndarray):
        self.known, bits = known, max(1, len(known).bit_length() - 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(known >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def places(self, g: np.ndarray) -> np.ndarray:
        """Place of each key; the number of known ones if it isn't there."""
        out = np.full(len(g), len(self.known), np.int32)
        part = (g >> self.shift).astype(np.int64)
        i, end = self.first[part], self.first[part + 1]
        left = np.flatnonzero(i < end)
        i, end = i[left], end[left]
        while len(left):
            same = self.known[i] == g[left]
            out[left[same]] = i[same]
            i = i + np.int32(1)
            more = np.flatnonzero(~same & (i < end))
            left, i, end = left[more], i[more], end[more]
        return out


def _held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for _, part in W.slices(b.column(0)):
            w = W.words(part)
            key, _, left = sequences(w, W.hashes(w))
            yield key, left


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for key, _ in _parts(batches):
        held.append(key)
        size += len(key)
        if size >= COUNTED:
            yield _longs(*np.unique(np.concatenate(held), return_counts=True), names=["key", "n"])
            held, size = [], 0
    if size:
        yield _longs(*np.unique(np.concatenate(held), return_counts=True), names=["key", "n"])


def _ranges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted keys by their highest ``bits``, without empty ranges."""
    numbers, first, n = np.unique(keys >> np.uint64(64 - bits), return_index=True, return_counts=True)
    return list(zip(numbers.tolist(), first.tolist(), (first + n).tolist()))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte values of one length, their bytes by place, compressed."""
    return pa.compress(np.concatenate([np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).ravel() for c in columns]), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    """The columns that were packed, each of ``n`` values."""
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n * len(kinds), codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(raw[8 * n * i: 8 * n * (i + 1)].reshape(8, n).T).ravel().view(kind) for i, kind in enumerate(kinds)]


_COUNTS = "part long, size long, firsts long, lasts long, first binary, last binary, data binary"


def _pack_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[int, int, int, bytes, bytes, bytes]:
    """Grams' two parts and counts, a part's distinct keys once: numbers of grams and of keys, keys, and places with counts."""
    by = np.argsort(a)
    (first, i), (last, j) = (np.unique(x, return_inverse=True) for x in (a[by], b[by]))
    keys = (_packed(np.diff(x, prepend=np.uint64(0))) for x in (first, last))
    return len(by), len(first), len(last), *keys, _packed(np.diff(i, prepend=0), j, n[by])


def _unpack_counts(size: int, firsts: int, lasts: int, first: bytes, last: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and n that were packed, in order of a."""
    i, j, n = _unpacked(data, size, np.int64, np.int64, np.int64)
    a, b = (np.cumsum(_unpacked(x, k, np.uint64)[0], dtype=np.uint64) for x, k in ((first, firsts), (last, lasts)))
    return a[np.cumsum(i)], b[j], n


def _gram_counts(k: int, kept: Callable[[list[np.ndarray], np.ndarray], np.ndarray], bits: int):
    """Batches to rows of ``_COUNTS``, one for each range of keys (by their highest ``bits``): how often the grams of k + 1
    symbols at the ``kept`` places occur; a and b are the keys of a gram without its last and without its first symbol."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            key, where, n = np.unique(join_keys(a, b), return_index=True, return_counts=True)
            a, b = a[where], b[where]
            rows = [(part, *_pack_counts(a[lo:hi], b[lo:hi], n[lo:hi])) for part, lo, hi in _ranges(key, bits)]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 3
            names = [c.split()[0] for c in _COUNTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

        for key, left in _parts(batches):
            levels = grams(key, k + 1)
            at = np.flatnonzero(kept(levels, left))
            held.append((levels[k - 1][at], levels[k - 1][at + 1]))
            size += len(at)
            if size >= COUNTED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return count


def _gram_sums(least: int):
    """A range's rows of ``_COUNTS`` to (a, b, n, key) of the grams that occur ``least`` times or more in all."""
    def sums(rows: pa.Table) -> pa.Table:
        a, b, n = (np.concatenate(x) for x in zip(*(_unpack_counts(*r) for r in zip(*(c.to_pylist() for c in rows.columns[1:])))))
        key, where, which = np.unique(join_keys(a, b), return_index=True, return_inverse=True)
        n = np.bincount(which, n).astype(np.int64)
        often = np.flatnonzero(n >= least)
        at = where[often]
        return pa.table({name: pa.array(x.view(np.int64)) for name, x in (("a", a[at]), ("b", b[at]), ("n", n[often]), ("key", key[often]))})

    return sums


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = join_keys(*(np.asarray(b.column(c)).view(np.uint64) for c in ("a", "b")))
        yield b.append_column("key", pa.array(key.view(np.int64)))


def tree(texts: DataFrame, order: int = ORDER, least: int = LEAST, state: int = STATE, gain: float = GAIN, prior: float = PRIOR,
         filter_bits: int = FILTER_BITS) -> tuple[DataFrame, int, int]:
    """The tree of the training texts (one string column; no nulls), the number of tokens and of distinct ones.

    Rows: key, n (occurrences), p (log10 probability of a
    gram's last symbol in the state of the others) and left (log10 share that
    the gram, as a state, leaves to its suffix); null where a gram is none of these.
    """
    with _tidy(texts.sparkSession):
        return _grown(texts, order, least, state, gain, prior, filter_bits)[:3]


def _grown(texts: DataFrame, order: int = ORDER, least: int = LEAST, state: int = STATE, gain: float = GAIN, prior: float = PRIOR,
           filter_bits: int = FILTER_BITS) -> tuple[DataFrame, int, int, _Tables]:
    """``tree``, and the tables of which its rows are one, ``model``."""
    sc, tables = texts.sparkSession.sparkContext, _Tables(texts.sparkSession)
    words = tables.written("words", texts.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    start = int(START.view(np.int64))
    total, distinct = words.where(F.col("key") != start).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    scale = total + 0.5 * (distinct + 1)
    bits = min(max(4, (int(total) // SUMMED).bit_length()), 24)
    sent = None

    def places(k: int, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
        """Where a gram of k + 1 symbols may be counted: all pairs; or contexts of pairs seen ``state`` times or more, then a
        pair seen ``least`` times or more."""
        if k == 1:
            return left > 0
        often, context = sent.value
        fit = (left > 0) & often.has(levels[1])
        before = fit if context is None else fit & context.has(levels[1])
        before = before.copy()
        for j in range(1, k):
            fit[:-1] = before[:-1] & fit[1:] & (left[:-1] > j)
            before[:-1] &= before[1:]
            fit[-1:] = before[-1:] = False
        return fit

    # Every context is followed by something: its occurrences are its transitions'. q: the last symbol in the longest retained state.
    before = words.select("key", "n", ((F.col("n") + 0.5) / scale).alias("q"))
    none = F.lit(None).cast("double")
    model = words.select("key", "n", none.alias("p"), none.alias("left"))
    of_a = Window.partitionBy("a")
    for k in range(1, order + 1):
        found = texts.mapInArrow(_gram_counts(k, partial(places, k), bits), _COUNTS) \
            .groupBy("part").applyInArrow(_gram_sums(least), "a long, b long, n long, key long")
        if k == 1 < order:
            found = tables.written("found-1", found)
            often = Filter(found.select("key"), filter_bits)
            sent = sc.broadcast((often, Filter(found.where(F.col("n") >= state).select("key"), filter_bits) if state > least else None))
        else:
            found = tables.written(f"found-{k}", found.drop("key"))
        moves = found.select("a", "b", "n").join(before.select(F.col("key").alias("b"), F.col("q").alias("low")), "b") \
            .join(before.where(F.col("n") >= state).select(F.col("key").alias("a"), F.col("n").alias("t")), "a") \
            .withColumn("own", F.sum("n").over(of_a)) \
            .withColumn("up", F.col("t") - F.col("own") + prior)        # mass left to the suffix
        rest = (F.col("t") - F.col("own")) * F.log(F.greatest(F.col("up") - 1, F.lit(prior)) / (F.col("t") - 1 + prior))
        gained = F.sum(F.col("n") * F.log(((F.col("n") - 1) / F.col("low") + F.col("up")) / (F.col("t") - 1 + prior))).over(of_a) + rest
        moves = moves.withColumn("kept", gained >= gain)
        if k == order:
            moves = moves.where("kept")                 # the others' suffixes have them
        seen = F.when(F.col("kept"), (F.col("n") + F.col("up") * F.col("low")) / (F.col("t") + prior)).otherwise(F.col("low"))
        own = [F.when(F.col("kept"), x).alias(name) for name, x in
               (("a", F.col("a")), ("t", F.col("t")), ("share", F.col("up") / (F.col("t") + prior)))]
        before = moves.select("a", "b", "n", "kept", "t", "up", seen.alias("q"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in before.schema) + ", key long"
        before = tables.written(f"grown-{k}", before.mapInArrow(_keyed, schema).select("key", "n", "q", "kept", *own))
        tables.drop(f"found-{k}")
        kept = before.where("kept")
        model = model.unionByName(kept.select("key", "n", F.log10("q").alias("p"), none.alias("left"))) \
            .unionByName(kept.select(F.col("a").alias("key"), F.col("t").alias("n"), none.alias("p"), F.log10("share").alias("left")))
    if sent is not None:
        sent.destroy()
    merged = tables.written("model", model.groupBy("key").agg(F.max("n").alias("n"), F.max("p").alias("p"), F.max("left").alias("left")))
    tables.drop("words", *(f"grown-{k}" for k in range(1, order + 1)))
    return merged, int(total), int(distinct), tables


def _pack(chunk_bytes: int):
    """Batches to (chunk, data): about ``chunk_bytes`` of whole rows as one compressed Arrow stream."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for b in held:
                    stream.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "data"])

        for b in batches:
            for first, part in W.slices(b.column("text"), chunk_bytes):
                rows = b.slice(first, len(part))
                if held and size + rows.nbytes > chunk_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(rows)
                size += rows.nbytes
        if held:
            yield out()

    return pack


def _unpack(data) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(data.as_py())) as stream:
        return stream.read_all()


def _trained(chunk: pa.Table) -> np.ndarray:
    """Whether each text of a chunk is a training text."""
    return np.array(pc.equal(chunk.column("held_out"), False).fill_null(False))


def _symbols(chunk: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, key, row, symbols left in the row) of a chunk's slices."""
    for first, part in W.slices(chunk.column("text")):
        w = W.words(part)
        yield first, len(part), *sequences(w, W.hashes(w))


def _asked(symbols: Iterable[tuple], trained: np.ndarray, order: int, known: Filter, repeated: Filter, head: np.ndarray) -> np.ndarray:
    """Keys of a chunk's words, and of its grams that the tree may hold, without those of its head and words that occur
    once in training; sorted."""
    out = [np.zeros(0, np.uint64)]
    for first, _, key, row, left in symbols:
        own = trained[first + row]
        out += [np.unique(key[~own]), (once := np.unique(key[own]))[repeated.has(once) | known.has(once)]]
        for k, g in enumerate(grams(key, order + 1)[1:], 1):
            g = g[left >= k]
            out.append(np.unique(g[known.has(g)]))
    keys = np.unique(np.concatenate(out))
    return keys[_places(head, keys) == len(head)]


def _looked_up(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """For each chunk that asked a range of keys: n, p and left of its keys, in their order; n is -1 where the tree has no row."""
    key, n, p, left = _sorted(rows)
    # Only words need their count. The last row is that of absent keys.
    n, p, left = np.append(np.where(np.isnan(p), n, 0), -1), np.append(p, np.nan), np.append(left, np.nan)
    data = []
    for size, given in zip(asked.column("size").to_pylist(), asked.column("data").to_pylist()):
        at = _places(key, np.cumsum(_unpacked(given, size, np.uint64)[0], dtype=np.uint64))
        data.append(_packed(n[at], p[at], left[at]))
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "size": asked.column("size"), "data": pa.array(data, pa.binary())})


def _answered(keys: np.ndarray, bits: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, n, p and left of the keys that the tree has, from the answers to a chunk."""
    got = {part: (size, data) for part, size, data in zip(*(rows.column(c).to_pylist() for c in ("part", "size", "data")))}
    n, p, left = np.full(len(keys), -1), np.full(len(keys), np.nan), np.full(len(keys), np.nan)
    for part, a, b in _ranges(keys, bits):
        size, data = got[part]
        if size != b - a:
            raise ValueError("a chunk's answers are not those to its keys")
        n[a:b], p[a:b], left[a:b] = _unpacked(data, size, np.int64, np.float64, np.float64)
    has = n >= 0
    return keys[has], n[has], p[has], left[has]


def _score(symbols: list[tuple], trained: np.ndarray, order: int, scale: float, own: tuple, head: tuple) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text, from the chunk's rows of the tree and the head's."""
    count = len(trained)
    out = [np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count), np.zeros(count)]
    # The head's rows, the chunk's, and an empty one.
    n, p, left = (np.concatenate([head[k], own[k], [0 if k == 1 else np.nan]]) for k in (1, 2, 3))

    frequent, others = _Index(head[0]), _Index(own[0])

    def at(g: np.ndarray) -> np.ndarray:
        out = frequent.places(g)
        rest = np.flatnonzero(out == len(head[0]))
        out[rest] = len(head[0]) + others.places(g[rest])
        return out

    for first, rows, seq, row, _ in symbols:
        places = [at(g) for g in grams(seq, order + 1)]
        target = np.flatnonzero(np.diff(row, prepend=-1) == 0)         # all but each text's start
        before = target - np.searchsorted(row, row[target])            # symbols before, the start included
        c = np.maximum(n[places[0][target]], trained[first + row[target]])        # a training word that wasn't asked for occurs once
        base = np.log10((c + 0.5) / scale)
        value, done = np.zeros(len(target)), np.zeros(len(target), bool)
        for k in range(order, 0, -1):
            use = np.flatnonzero(~done & (before >= k))
            share = left[places[k - 1][target[use] - k]]
            use, share = use[~np.isnan(share)], share[~np.isnan(share)]
            move = p[places[k][target[use] - k]]
            seen = ~np.isnan(move)
            value[use] += np.where(seen, move, share)
            done[use[seen]] = True
        value[~done] += base[~done]
        for j, x in enumerate((None, (c > 0).astype(float), base, value)):
            got = np.bincount(row[target], x, rows)
            out[j][first: first + rows] = got if j > 1 else got.astype(np.int64)
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
          order: int = ORDER, head: int = HEAD, **options) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the documents that aren't ``held_out``. A null or empty text is
    its end alone. Repeated rows count as often as they occur; null ids stay null.
    Without training documents every token has the probability of an unknown one.
    An empty table gives no rows. Scores are log10 probabilities; base_score is the
    smoothed word frequency's. The texts are kept in written chunks, by their place
    in the table, so that equal rows don't meet in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    with _tidy(spark):
        model, total, distinct, tables = _grown(rows.where("NOT held_out").select("text"), order=order, **options)
        chunks = tables.written("chunks", rows.mapInArrow(_pack(chunk_bytes), "chunk long, data binary"))
        limit = options.get("filter_bits", FILTER_BITS)
        grown = Filter(model.where("p IS NOT NULL OR left IS NOT NULL").select("key"), limit)
        repeated = Filter(model.where("n > 1 AND p IS NULL").select("key"), limit)
        least, frequent = _head(model, head)
        scale, top = total + 0.5 * (distinct + 1), _sorted(frequent)
        bits = min(max(6, (model.count() // RANGE).bit_length()), 24)
        sent = spark.sparkContext.broadcast((grown, repeated, top))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, repeated, top = sent.value
            for b in batches:
                for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                    chunk = _unpack(data)
                    keys = _asked(_symbols(chunk), _trained(chunk), order, known, repeated, top[0])
                    some = _ranges(keys, bits)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r for r, _, _ in some], pa.int64()), pa.array([number] * len(some), pa.int64()),
                        pa.array([b - a for _, a, b in some], pa.int64()),
                        pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in some], pa.binary())],
                        names=["part", "chunk", "size", "data"])

        found = model.where(F.col("n") < least).withColumn("part", F.shiftrightunsigned("key", 64 - bits))
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

        def scored(held: pa.Table, rows: pa.Table) -> pa.Table:
            chunk = _unpack(held.column("data")[0])
            known, repeated, top = sent.value
            symbols, trained = list(_symbols(chunk)), _trained(chunk)
            keys = _asked(symbols, trained, order, known, repeated, top[0])
            n_tokens, n_known, base, value = _score(symbols, trained, order, scale, _answered(keys, bits, rows), top)
            return pa.table({"doc_id": chunk.column("doc_id"), "held_out": chunk.column("held_out"), "n_tokens": n_tokens, "n_known": n_known,
                             "train_tokens": np.full(len(base), total, np.int64), "base_score": base, "score": value})

        portions = PORTIONS if chunks.select("chunk").count() > WHOLE else 1
        out = None
        for k in range(portions):
            some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(portions)) == k)
            name = "answers" if k == portions - 1 else f"answers-{k}"
            answers = tables.written(name, some.mapInArrow(asked, "part long, chunk long, size long, data binary").groupBy("part")
                                     .cogroup(found.groupBy("part")).applyInArrow(_looked_up, "chunk long, part long, size long, data binary"))
            own = some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema)
            if k < portions - 1:
                own = tables.written(f"scores-{k}", own)
                tables.drop(name)
            out = own if out is None else out.unionByName(own)
        tables.drop("model")
    return out


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; one fold of five is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, _held_out(docs["doc_id"], 5, 1))


QUERIES = {"op1_suffix_tree": op1_suffix_tree}
ORACLES: dict[str, str] = {}
