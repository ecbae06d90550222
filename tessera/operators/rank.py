"""Ranking and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """K1 + K2: stable descending sort and the first n rows (TakeOrderedAndProject:
    per-partition top-n, then a merge of n rows per partition). No NA padding (N8)."""
    return df.orderBy(*_order(order)).limit(n)


def rank_within(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column],
                n: int | None = None, name: str = "rank") -> DataFrame:
    """``row_number`` per group under a total order; keep ranks <= n.

    Rank k of the reference (``top[k, ]``) is ``rank == k``.
    """
    w = Window.partitionBy(*partition).orderBy(*_order(order))
    out = df.withColumn(name, F.row_number().over(w))
    return out.where(F.col(name) <= n) if n is not None else out


def top_row_per_group(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The best row of each group (``head(arrange(filter(..), desc(x)), 1)``).

    ``order`` is a list of (column, ascending); descending keys must be numeric.
    A ``min_by`` aggregate keeps one candidate row per group in each task and
    merges them: no group is ever gathered in one place, so a hot group costs
    no more than any other. NULLs sort last, as in the reference's arrange.
    """
    key = []
    for c, asc in order:
        v = F.col(c) if asc else -F.col(c)
        key += [F.col(c).isNull(), v]
    others = [c for c in df.columns if c not in partition]
    row = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*partition).agg(F.min_by(row, F.struct(*key)).alias("__best"))
              .select(*partition, *[F.col(f"__best.{c}").alias(c) for c in others]))
