"""Sufficient statistics for linear models (L1).

One pass over the data whatever the number of models fitted later: a task
ships its (k + 1)(k + 2)/2 sums of shifted products, never rows. Every later model (subsets, stepwise moves, VIFs) is small-matrix algebra on
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """Centred cross products of ``names`` (the response last), their means and n."""

    names: list[str]
    mean: np.ndarray
    cross: np.ndarray          # sum (x_i - mean_i)(x_j - mean_j)
    n: int

    def index(self, name: str) -> int:
        return self.names.index(name)

    def raw(self) -> np.ndarray:
        """Uncentred sums of products including an intercept column (first)."""
        k = len(self.names)
        g = np.zeros((k + 1, k + 1))
        g[0, 0] = self.n
        g[0, 1:] = g[1:, 0] = self.n * self.mean
        g[1:, 1:] = self.cross + self.n * np.outer(self.mean, self.mean)
        return g


def _pairs(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    """L1: k x k centred statistics from one pass, for any number of columns.

    Shifted-data sums: with a shift K taken from one data row (a cheap
    ``limit(1)``), each task multiplies its batches' matrices and ships
    (k + 1)(k + 1) sums, never rows; those of all tasks are added up on the
    cluster. Since K sits inside the data the centring does not cancel
    catastrophically as raw sums of squares would.
    """
    cols = list(cols)
    k = len(cols)
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    first = src.limit(1).collect()
    if not first:
        return Gram(cols, np.zeros(k), np.zeros((k, k)), 0)
    shift = np.array(list(first[0]), dtype=float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[np.asarray(c) for c in b.columns]])
            x[:, 1:] -= shift
            total += x.T @ x
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    s = np.zeros((k + 1, k + 1))
    for r in src.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        s[r["i"], r["j"]] = s[r["j"], r["i"]] = r["v"]
    n = int(round(s[0, 0]))
    t = s[0, 1:]
    return Gram(cols, shift + t / n, s[1:, 1:] - np.outer(t, t) / n, n)


def gram_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L1 as a long table (row_var, col_var, cross, mean_row, mean_col, n), upper triangle."""
    g = gram(df, cols)
    k = len(g.names)
    rows = [(g.names[i], g.names[j], float(g.cross[i, j]), float(g.mean[i]), float(g.mean[j]), g.n)
            for i, j in _pairs(k)]
    return df.sparkSession.createDataFrame(
        rows, "row_var string, col_var string, cross double, mean_row double, mean_col double, n long")
