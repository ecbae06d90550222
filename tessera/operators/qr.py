"""Least squares by tall-skinny QR (L2, L3): the accurate path beside the Gram matrix.

A product matrix squares the condition of a design; a triangular factor does
not. Each task factors its rows batch by batch into one small triangle, the
triangles of many tasks meet in a tree of factorisations, and the last one, as
wide as the design, is all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.regress import Fit

FAN_IN = 32           # triangles that meet in one task of the tree
TOLERANCE = 1e-7      # share of a column's length that must be left after those before it


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _row(triangle: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["r", "n"])


def triangle(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, int]:
    """R of the QR factorisation of a constant and ``cols``, and the number of rows without a null.

    At most (k + 1)^2 numbers a task are shuffled, whatever the number of rows. An empty table has no row of R.
    """
    k = len(cols) + 1
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, k)), 0
        for b in batches:
            if b.num_rows:
                r = _triangle(np.vstack([r, np.column_stack([np.ones(b.num_rows), *[np.asarray(c) for c in b.columns]])]))
                n += b.num_rows
        if n:
            yield _row(r, n)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, k)), 0
        for b in batches:
            for data, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = _triangle(np.vstack([r, np.frombuffer(data).reshape(-1, k)]))
                n += m
        if n:
            yield _row(r, n)

    parts = src.mapInArrow(factor, "r binary, n long")
    # A level of the tree for each power of the fan-in that the session's number of partitions holds, one at least.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width, F.xxhash64("r")).mapInArrow(join, "r binary, n long")
        if width <= FAN_IN:
            break
    r, n = np.zeros((0, k)), 0
    for row in parts.collect():                 # the last level: FAN_IN triangles at most
        r = _triangle(np.vstack([r, np.frombuffer(row["r"]).reshape(-1, k)]))
        n += row["n"]
    return r, n


def ols_qr(df: DataFrame, response: str, terms: Sequence[str], tol: float = TOLERANCE) -> Fit:
    """L2 + L3: least squares on a constant and ``terms``. Terms enter in order; one of which less than ``tol`` of
    its length is left by those before it is dropped, as a pivoted factorisation moves it to the end."""
    r, n = triangle(df, [*terms, response])
    names, k = list(terms), len(terms) + 1
    r = np.vstack([r, np.zeros((max(0, k + 1 - len(r)), k + 1))])
    y, q, upper, keep = r[:, k], np.zeros((len(r), 0)), np.zeros((0, 0)), []
    for j in range(k):
        v, size = r[:, j], float(np.linalg.norm(r[:, j]))
        part = q.T @ v
        rest = v - q @ part
        again = q.T @ rest                      # once more, for what rounding left
        part, rest = part + again, rest - q @ again
        left = float(np.linalg.norm(rest))
        if not size or left <= tol * size:
            continue
        grown = np.zeros((len(keep) + 1, len(keep) + 1))
        grown[:-1, :-1], grown[:-1, -1], grown[-1, -1] = upper, part, left
        upper, q = grown, np.column_stack([q, rest / left])
        keep.append(j)
    rest = y - q @ (q.T @ y)
    beta = np.linalg.solve(upper, q.T @ y) if keep else np.zeros(0)
    rss, tss = float(rest @ rest), float(y[1:] @ y[1:])
    inverse = np.linalg.inv(upper) if keep else np.zeros((0, 0))
    s2 = rss / (n - len(keep)) if n > len(keep) else float("nan")
    se = np.sqrt((inverse ** 2).sum(axis=1) * s2)
    used = [i for i, j in enumerate(keep) if j]
    first = 0 in keep
    return Fit(response, [names[keep[i] - 1] for i in used], [t for j, t in enumerate(names, 1) if j not in keep],
               float(beta[0]) if first else math.nan, beta[used], se[used], float(se[0]) if first else math.nan, rss, tss, n)
