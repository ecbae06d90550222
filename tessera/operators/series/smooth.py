"""Simple exponential smoothing (T2-T4) for many series at once.

A series is one row with the array of its periods: the level recursion
``l_t = a x_t + (1 - a) l_{t-1}`` (``l_1 = x_1``) is a fold over it. The calendar
bounds the array, not the data volume: more data means more series, not longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matrix import let


def _levels(values: Column, alpha: Column) -> Column:
    zero = F.struct(F.lit(None).cast("double").alias("level"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        level = F.when(F.size(s["all"]) == 0, x).otherwise(alpha * x + (1.0 - alpha) * s["level"])
        return let(level, lambda v: F.struct(v.alias("level"), F.concat(s["all"], F.array(v)).alias("all")))

    return F.aggregate(values, zero, step, lambda s: s["all"])


def ses_levels(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value",
               alpha: float | list[float] = 0.5) -> DataFrame:
    """Level after each observation -> (series, idx, value, level).

    With a list of alphas (T3) all run on the same gathered series and an
    ``alpha`` column is added.
    """
    many = isinstance(alpha, (list, tuple))
    alphas = F.array(*[F.lit(float(a)) for a in (alpha if many else [alpha])])
    rows = df.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("x")))).alias("r"))
    rows = rows.select(series, "r", F.explode(alphas).alias("alpha"))
    out = rows.select(series, "alpha", F.explode(F.arrays_zip(F.col("r.i").alias("i"), F.col("r.x").alias("x"),
                                                              _levels(F.col("r.x"), F.col("alpha")).alias("l"))).alias("z"))
    out = out.select(series, "alpha", F.col("z.i").alias(idx), F.col("z.x").alias(value), F.col("z.l").alias("level"))
    return out if many else out.drop("alpha")


def ses_grid(df: DataFrame, alphas, series: str = "series", idx: str = "idx",
             value: str = "value") -> DataFrame:
    """Every series x every alpha; one-step-ahead MSE of the fitted level."""
    lv = ses_levels(df, series, idx, value, list(alphas))
    w = Window.partitionBy(series, "alpha").orderBy(idx)
    err = F.col(value) - F.lag("level", 1).over(w)
    return (lv.withColumn("__e", err)
              .groupBy(series, "alpha")
              .agg(F.avg(F.col("__e") * F.col("__e")).alias("mse"),
                   F.count("__e").alias("n_errors")))


def ses_fitted(levels: DataFrame, series: str = "series", idx: str = "idx") -> DataFrame:
    """T4: smoothed value i = level after x_i for i < n; the n-th repeats the (n-1)-th
    (the fitted part of the smoother has one value fewer than the data)."""
    w = Window.partitionBy(series).orderBy(idx)
    n = F.max(idx).over(Window.partitionBy(series))
    prev = F.lag("level", 1).over(w)
    return levels.withColumn("smoothed", F.when((F.col(idx) == n) & (n > 1), prev).otherwise(F.col("level")))
