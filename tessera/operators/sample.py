"""Deterministic sampling and splits.

A key hash (two MINSTD steps on the key) decides membership, so a split does
not change when the data is re-partitioned or a task is retried (``randomSplit``
can), and any engine can recompute it. Exact sizes come from the rank of that
hash: counts by bucket of hash values find the bucket in which a sample ends, and
only that bucket's keys are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relate import maybe_broadcast
from tessera.session import materialize

# Fixed values of the key mix: MINSTD multipliers and modulus.
MIX_MULT = 48271
SALT_MULT = 69621
MIX_MOD = 2147483647


def hash_int(key: str | Column, salt: int = 0) -> Column:
    """Key -> integer below 2^31-1 from two multiplicative steps modulo it.

    A NULL key counts as 0, so every row has a place. Each ``salt`` above 0 adds
    that many steps with another multiplier: purposes with different salts (a
    split and the folds inside its parts) are cut independently of one another.
    """
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("long"), F.lit(0).cast("long"))
    h = F.pmod(k, F.lit(MIX_MOD))
    h = F.pmod(h * F.lit(MIX_MULT), F.lit(MIX_MOD))
    h = F.pmod(h * F.lit(MIX_MULT), F.lit(MIX_MOD))
    for _ in range(salt):
        h = F.pmod(h * F.lit(SALT_MULT) + F.lit(MIX_MULT), F.lit(MIX_MOD))
    return h


def hash_unit(key: str | Column, salt: int = 0) -> Column:
    """The same as a number in [0, 1)."""
    return hash_int(key, salt) / F.lit(float(MIX_MOD))


def hash_unit_sql(key: str, salt: int = 0) -> str:
    """The same mix as SQL text (for oracles)."""
    m, a = MIX_MOD, MIX_MULT
    h = f"((((((coalesce({key}, 0) % {m}) + {m}) % {m}) * {a}) % {m}) * {a}) % {m}"
    for _ in range(salt):
        h = f"(({h}) * {SALT_MULT} + {a}) % {m}"
    return f"({h}) / {float(m)}"


def split_flag(key: str | Column, fraction: float) -> Column:
    """M1: True for the training part (``fraction`` of keys), False for the rest."""
    return hash_unit(key) < F.lit(fraction)


def train_test(df: DataFrame, key: str, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """M1 + U2: the training rows and their complement (a negated predicate,
    not ``exceptAll``: no second shuffle)."""
    flag = split_flag(key, fraction)
    return df.where(flag), df.where(~flag)


SELECT_BITS, RANK_BITS = 15, 19       # hash bits inside a bucket: 65,536 buckets to select in, 4,096 to rank in


def cut_points(df: DataFrame, key: str, fraction: float, strata: str | None = None, salt: int = 0) -> DataFrame:
    """(stratum, h, k): the last hash and key of each stratum's first trunc(fraction * n) rows in order of hash, then key.

    Rows of one key stay together: where the size falls among them, they all stay out. A stratum whose
    sample is empty has a hash below all. One row a stratum; a bucket's keys are ordered at most.
    """
    rows = df.select((F.col(strata) if strata else F.lit(0)).alias("stratum"), hash_int(key, salt).alias("h"),
                     F.col(key).cast("long").alias("k")).withColumn("bucket", F.shiftright("h", SELECT_BITS))
    order, whole = Window.partitionBy("stratum").orderBy("bucket"), Window.partitionBy("stratum")
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("c")) \
        .withColumns({"upto": F.sum("c").over(order), "size": F.floor(F.lit(fraction) * F.sum("c").over(whole))})
    # The first bucket that isn't wholly inside; after the last bucket where all are.
    edge = materialize(counts.groupBy("stratum").agg(
        F.first("size").alias("size"), F.min(F.when(F.col("upto") > F.col("size"), F.col("bucket"))).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("size"), F.col("upto"))), F.lit(0)).alias("before")))
    inside = rows.join(maybe_broadcast(edge.withColumnRenamed("stratum", "s")), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge")))
    by_key = inside.groupBy("stratum", "h", "k").agg(F.count("*").alias("c"), F.first("size").alias("size"), F.first("before").alias("before")) \
        .withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("stratum").orderBy("h", F.asc_nulls_first("k"))))
    # The rows before the first key that goes beyond the size, so that no smaller key after it slips in.
    found = by_key.where(F.col("upto") <= F.col("size")).groupBy("stratum").agg(F.max_by(F.struct("h", "k"), "upto").alias("at"))
    below = F.struct(F.coalesce(F.shiftleft("edge", SELECT_BITS), F.lit(MIX_MOD + 1)).cast("long") - 1, F.lit(2**63 - 1)).cast("struct<h: bigint, k: bigint>")
    return edge.join(found.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")), "left") \
        .select("stratum", F.coalesce("at", below).alias("at")).select("stratum", "at.h", "at.k")


def _up_to(key: str, salt: int, h: Column, k: Column) -> Column:
    own = F.col(key).cast("long")
    return (hash_int(key, salt) < h) | ((hash_int(key, salt) == h) & (own.isNull() | F.coalesce(own <= k, F.lit(False))))


def exact_flag(df: DataFrame, key: str, fraction: float, strata: str | None = None, salt: int = 0, name: str = "is_train") -> DataFrame:
    """M1 / M2: ``df`` with a flag that is true for exactly trunc(fraction * n) rows, overall or of each stratum: those
    of least hash. Rows of one key share a flag, so repeated keys may make the sample smaller, never larger. Two passes over the key
    (and the stratum) find the cut; the table itself isn't shuffled."""
    if strata is None:
        cut = cut_points(df, key, fraction, None, salt).first()
        if cut is None:
            return df.withColumn(name, F.lit(False))
        return df.withColumn(name, _up_to(key, salt, F.lit(cut["h"]), F.lit(cut["k"])))
    cut = materialize(cut_points(df, key, fraction, strata, salt)).select(F.col("stratum").alias("_stratum"), F.col("h").alias("_h"), F.col("k").alias("_k"))
    return df.join(maybe_broadcast(cut), F.col(strata).eqNullSafe(F.col("_stratum")), "left") \
        .withColumn(name, _up_to(key, salt, F.col("_h"), F.col("_k"))).drop("_stratum", "_h", "_k")


def train_test_exact(df: DataFrame, key: str, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """M1 + U2: exactly trunc(fraction * n) rows, and the others."""
    both = exact_flag(df, key, fraction, name="_train")
    return both.where("_train").drop("_train"), both.where("NOT _train").drop("_train")


def balanced_folds(df: DataFrame, key: str, strata: str, k: int = 5, name: str = "fold") -> DataFrame:
    """M3: ``df`` with a fold 0..k-1 that deals each stratum's rows out in turn, in order of the key's hash: a stratum's folds differ
    by one row at most. The rank is a bucket's rank, from the counts of the buckets before it, plus the
    place in the bucket, so a stratum that holds most rows is spread over all buckets."""
    rows = df.withColumns({"_h": hash_int(key, FOLD_SALT), "_s": F.col(strata)}).withColumn("_b", F.shiftright("_h", RANK_BITS))
    before = rows.groupBy("_s", "_b").agg(F.count("*").alias("_c")).withColumn(
        "_before", F.sum("_c").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_c")).drop("_c")
    before = materialize(before).select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), "_before")
    place = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))
    return rows.withColumn("_place", place).join(maybe_broadcast(before), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2"))) \
        .withColumn(name, ((F.col("_before") + F.col("_place") - 1) % k).cast("int")).drop("_h", "_s", "_b", "_s2", "_b2", "_before", "_place")


# Folds and subsamples don't follow the split: their hashes have salts of their own.
FOLD_SALT, SAMPLE_SALT = 1, 2


def fold_of(key: str | Column, k: int = 5) -> Column:
    """M3: fold number 0..k-1 from the key hash, independent of ``split_flag``."""
    return F.floor(hash_unit(key, FOLD_SALT) * F.lit(k)).cast("int")


def key_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """M2: 1/30-style subsample by key hash (same rows on every run)."""
    return df.where(hash_unit(key, SAMPLE_SALT) < F.lit(fraction))


def stratified_sample(df: DataFrame, key: str, strata: str, fractions: dict | float) -> DataFrame:
    """M2, stratified: a per-stratum fraction applied to the key hash."""
    if isinstance(fractions, (int, float)):
        return key_sample(df, key, float(fractions))
    frac = F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.where(hash_unit(key, SAMPLE_SALT) < F.coalesce(F.try_element_at(frac, F.col(strata)), F.lit(0.0)))
