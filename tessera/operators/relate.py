"""Joins (J1-J5) and the size-checked broadcast used by every lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows under which a lookup side is broadcast after its size is checked.
DEFAULT_BROADCAST_ROWS = 1_000_000


def row_bound(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a checked row bound; otherwise leave the
    choice to the planner (sort-merge join, AQE may still convert it at run time
    from measured sizes)."""
    return F.broadcast(df) if row_bound(df, max_rows) else df


def null_safe_join(left: DataFrame, right: DataFrame, left_on: Sequence[str] | str,
                   right_on: Sequence[str] | str, how: str = "inner",
                   drop_right_keys: bool = True) -> DataFrame:
    """Equi-join on differently named keys where NULL matches NULL.

    ``<=>`` stays an equi-join key for the planner (hash / sort-merge), so the
    join still shuffles on the key and never degrades to a nested loop.
    """
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = [right_on] if isinstance(right_on, str) else list(right_on)
    cond: Column | None = None
    for a, b in zip(lk, rk):
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    out = left.join(right, cond, how)
    if drop_right_keys:
        for b in rk:
            out = out.drop(right[b])
    return out


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str,
           out: str | None = None, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Dictionary lookup, unmatched -> NULL (left join on a checked-small table)."""
    t = table.select(F.col(table_key).alias("__lk_key"), F.col(value).alias(out or value))
    res = df.join(maybe_broadcast(t, max_rows), F.col(key) == F.col("__lk_key"), "left")
    return res.drop("__lk_key")


def param_grid(spark, **params: Sequence) -> DataFrame:
    """Cartesian product of parameter value lists as a small DataFrame
    (built from the lists, no join)."""
    import itertools

    names = list(params)
    rows = list(itertools.product(*[list(params[n]) for n in names]))
    return spark.createDataFrame(rows, names)
