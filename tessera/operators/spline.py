"""A smooth trend with standard errors: a penalised cubic spline of y over x.

The basis is cubic B-splines on equal cells of x's range. A row touches four of
them, so what the fit needs of the data is ten products, four sums and a count a
cell: one aggregate, as many rows as cells, however many rows there are. The
weight of the penalty on second differences is the one of least generalised
cross-validation over a fixed grid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 20
WEIGHTS = [10.0 ** (k / 2) for k in range(-12, 13)]       # of the penalty, relative to the data's products


def basis(t: Column) -> list[Column]:
    """The four cubic B-splines that reach into a cell, at the place t (0 to 1) in it."""
    s = F.lit(1.0) - t
    return [s * s * s / 6.0, (3.0 * t * t * t - 6.0 * t * t + 4.0) / 6.0, (3.0 * s * s * s - 6.0 * s * s + 4.0) / 6.0, t * t * t / 6.0]


def penalty(m: int) -> np.ndarray:
    d = np.diff(np.eye(m), n=2, axis=0)
    return d.T @ d


@dataclass
class Smooth:
    lo: float
    hi: float
    mean: float           # of y, taken off before the fit
    beta: np.ndarray
    cov: np.ndarray
    weight: float
    edf: float
    rss: float
    n: int

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fitted values and their standard errors at points inside the range."""
        cells = len(self.beta) - 3
        u = (np.asarray(x, float) - self.lo) / (self.hi - self.lo) * cells
        j = np.clip(np.floor(u), 0, cells - 1).astype(int)
        t = u - j
        s = 1.0 - t
        b = np.zeros((len(u), cells + 3))
        for a, w in enumerate((s**3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (3 * s**3 - 6 * s**2 + 4) / 6, t**3 / 6)):
            b[np.arange(len(u)), j + a] = w
        return self.mean + b @ self.beta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", b, self.cov, b), 0.0))


def fit(df: DataFrame, x: str | Column, y: str | Column, cells: int = CELLS, weights=WEIGHTS) -> Smooth | None:
    """The smooth of y over x on the rows where both are there; None where x takes fewer than two values."""
    rows = df.select((F.col(x) if isinstance(x, str) else x).cast("double").alias("x"), (F.col(y) if isinstance(y, str) else y).cast("double").alias("y")) \
        .where("x IS NOT NULL AND y IS NOT NULL")
    r = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("y").alias("mean"), F.count("*").alias("n")).first()
    if not r["n"] or r["lo"] == r["hi"]:
        return None
    u = (F.col("x") - r["lo"]) / (r["hi"] - r["lo"]) * cells
    at = rows.select(F.least(F.floor(u), F.lit(cells - 1)).cast("int").alias("j"), u.alias("u"), (F.col("y") - r["mean"]).alias("y"))
    b = basis(F.col("u") - F.col("j"))
    pairs = [(p, q) for p in range(4) for q in range(p, 4)]
    sums = at.groupBy("j").agg(*[F.sum(b[p] * b[q]).alias(f"s{p}{q}") for p, q in pairs], *[F.sum(b[p] * F.col("y")).alias(f"r{p}") for p in range(4)],
                               F.sum(F.col("y") * F.col("y")).alias("yy")).collect()
    m = cells + 3
    g, v, yy = np.zeros((m, m)), np.zeros(m), 0.0
    for c in sorted(sums, key=lambda c: c["j"]):
        for p, q in pairs:
            g[c["j"] + p, c["j"] + q] += c[f"s{p}{q}"]
            if p != q:
                g[c["j"] + q, c["j"] + p] += c[f"s{p}{q}"]
        for p in range(4):
            v[c["j"] + p] += c[f"r{p}"]
        yy += c["yy"]
    pen, n = penalty(m), r["n"]
    scale, best = np.trace(g) / np.trace(pen), None
    for k in weights:
        inverse = np.linalg.inv(g + k * scale * pen)
        beta = inverse @ v
        edf = float(np.sum(inverse * g))
        rss = max(float(yy - 2 * beta @ v + beta @ g @ beta), 0.0)
        if n > edf:
            gcv = n * rss / (n - edf) ** 2
            if best is None or gcv < best[0] * (1 - 1e-9):
                best = gcv, k, inverse, beta, edf, rss
    if best is None:
        return None
    _, k, inverse, beta, edf, rss = best
    return Smooth(r["lo"], r["hi"], r["mean"], beta, inverse * (rss / (n - edf)), k, edf, rss, n)


def smooth_trend(df: DataFrame, x: str | Column, y: str | Column, points: int = 21, cells: int = CELLS) -> DataFrame:
    """(x, fit, std_error, lo, hi): the smooth at equally spaced points of x's range with 95 % bounds; no rows where
    there is nothing to fit."""
    s = fit(df, x, y, cells)
    rows = []
    if s is not None:
        at = s.lo + (s.hi - s.lo) * np.arange(points) / (points - 1)
        rows = [(float(a), float(f), float(e), float(f - 1.96 * e), float(f + 1.96 * e)) for a, f, e in zip(at, *s.at(at))]
    return df.sparkSession.createDataFrame(rows, "x double, fit double, std_error double, lo double, hi double")


def smooth_sql(rows: str, points: int = 21, cells: int = CELLS, weights=WEIGHTS) -> str:
    """The same of a relation (x, y) without nulls as CTEs for an oracle: smooth(x, fit, std_error)."""
    m = cells + 3
    pen = penalty(m)
    literal = "[" + ", ".join("[" + ", ".join(f"{v:.1f}" for v in row) + "]" for row in pen) + "]"
    four = "[pow(1 - t, 3) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (3 * pow(1 - t, 3) - 6 * pow(1 - t, 2) + 4) / 6, t * t * t / 6]"
    return f"""rng AS MATERIALIZED (SELECT min(x) AS lo, max(x) AS hi, avg(y) AS my, count(*) AS n FROM {rows}),
cl AS (SELECT j, u - j AS t, y - my AS y FROM (SELECT y, my, u, least(floor(u), {cells - 1}) AS j FROM (
  SELECT y, my, (x - lo) / (hi - lo) * {cells} AS u FROM {rows}, rng))),
bw AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS j, y, {four} AS w FROM cl),
ab AS (SELECT unnest(range(4)) AS a),
gl AS (SELECT j + p.a AS r, j + q.a AS c, sum(w[p.a + 1] * w[q.a + 1]) AS v FROM bw, ab p, ab q GROUP BY ALL),
ix AS (SELECT unnest(range({m})) AS i),
g0 AS MATERIALIZED (SELECT list(row ORDER BY i) AS g FROM (SELECT a.i, list(coalesce(v, 0) ORDER BY b.i) AS row
  FROM ix a CROSS JOIN ix b LEFT JOIN gl ON r = a.i AND c = b.i GROUP BY a.i)),
v0 AS MATERIALIZED (SELECT list(coalesce(v, 0) ORDER BY i) AS v FROM ix LEFT JOIN (SELECT j + a AS r, sum(w[a + 1] * y) AS v FROM bw, ab GROUP BY ALL) ON r = i),
wt AS (SELECT unnest([{", ".join(repr(k) for k in weights)}]) AS k),
sp(k, s, mat) AS (SELECT k, 1, list_transform({literal}::DOUBLE[][], lambda row, i: list_transform(row, lambda z, j:
    g[i][j] + k * list_sum(list_transform(range(1, {m + 1}), lambda q: g[q][q])) / {np.trace(pen):.1f} * z)) FROM wt, g0
  UNION ALL SELECT k, s + 1, list_transform(mat, lambda row, i: list_transform(row, lambda z, j:
    CASE WHEN i = s AND j = s THEN 1 / mat[s][s] WHEN i = s THEN mat[s][j] / mat[s][s] WHEN j = s THEN -mat[i][s] / mat[s][s]
         ELSE z - mat[i][s] * mat[s][j] / mat[s][s] END)) FROM sp WHERE s <= {m}),
be AS MATERIALIZED (SELECT k, mat, g, v, list_transform(mat, lambda row: list_dot_product(row, v)) AS beta,
  list_sum(list_transform(mat, lambda row, i: list_dot_product(row, g[i]))) AS edf FROM sp, g0, v0 WHERE s = {m + 1}),
sc AS (SELECT *, greatest(yy - 2 * list_dot_product(beta, v) + list_dot_product(beta, list_transform(g, lambda row: list_dot_product(row, beta))), 0) AS rss
  FROM be, (SELECT sum(y * y) AS yy FROM bw)),
bs AS (SELECT *, n * rss / pow(n - edf, 2) AS gcv, rss / (n - edf) AS s2 FROM sc, rng QUALIFY row_number() OVER (ORDER BY n * rss / pow(n - edf, 2), k) = 1),
pt AS (SELECT lo + (hi - lo) * i / {points - 1} AS x, beta, mat, my, s2, {cells} * i / {points - 1} AS u FROM bs, (SELECT unnest(range({points})) AS i)),
pw AS (SELECT *, {four} AS w FROM (SELECT *, u - j AS t FROM (SELECT *, CAST(least(floor(u), {cells - 1}) AS INTEGER) AS j FROM pt))),
smooth AS (SELECT x, my + list_dot_product(w, beta[j + 1:j + 4]) AS fit,
  sqrt(greatest(s2 * list_dot_product(w, list_transform(mat[j + 1:j + 4], lambda row: list_dot_product(w, row[j + 1:j + 4]))), 0)) AS std_error FROM pw)"""
