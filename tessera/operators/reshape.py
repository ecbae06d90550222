"""Reshape and order-index operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 key: str = "main_sector", value: str = "flag",
                 keep_nonzero: bool = True, drop_value: bool = True) -> DataFrame:
    """Unpivot 0/1 indicator columns, keep the ones, drop the flag."""
    long = df.unpivot(list(ids), list(values), key, value)
    if keep_nonzero:
        long = long.where(~(F.col(value) == 0))
    return long.drop(value) if drop_value else long


def measures_to_series(df: DataFrame, key: str, time: str, measures: Sequence[str],
                       series: str = "series", value: str = "value", sep: str = ":") -> DataFrame:
    """One long ``(series, time, value)`` table for every key and measure,
    instead of one slice per (key, measure)."""
    long = df.unpivot([key, time], list(measures), "__measure", value)
    return long.select(F.concat_ws(sep, F.col(key), F.col("__measure")).alias(series),
                       F.col(key), F.col("__measure").alias("measure"), F.col(time), F.col(value))


def add_index(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """1..n position within each group under a named order (N15: present
    periods are counted; gaps close up)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def fill_month_gaps(df: DataFrame, series: str, month: str, values: Sequence[str],
                    fill: float = 0.0) -> DataFrame:
    """N15 option: every month between a series' first and last month, missing
    ones filled with ``fill`` (``month`` is ``YYYY-MM`` text). The calendar is
    generated per series from its own bounds (one small aggregate, then a
    ``sequence`` explode), and the data joins onto it on (series, month)."""
    bounds = (df.groupBy(series)
                .agg(F.min(month).alias("__lo"), F.max(month).alias("__hi"))
                .select(series, F.explode(F.sequence(F.to_date(F.concat("__lo", F.lit("-01"))),
                                                     F.to_date(F.concat("__hi", F.lit("-01"))),
                                                     F.expr("interval 1 month"))).alias("__d"))
                .select(series, F.date_format("__d", "yyyy-MM").alias(month)))
    out = bounds.join(df, [series, month], "left")
    return out.fillna({v: fill for v in values})


def holdout_split(df: DataFrame, series: str = "series", idx: str = "idx", horizon: int = 6,
                  name: str = "is_test") -> DataFrame:
    """The last ``horizon`` positions of each series are the test part."""
    n = F.max(idx).over(Window.partitionBy(series))
    return df.withColumns({"n_obs": n, name: F.col(idx) > n - F.lit(horizon)})


def append_kind(frames: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Stack frames of the same columns with a label column."""
    out = None
    for k, f in frames.items():
        f = f.withColumn(kind, F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
