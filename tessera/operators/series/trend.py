"""Trend + seasonality regression for many series.

Model: y ~ sin(a M) * poly(M, 3) + cos(b M) * poly(M, 3) + M, M = 1..n. The
polynomial uses powers of M scaled to [-1, 1] (same column space as the
orthogonal basis, far better conditioned); M itself is collinear with the
linear power and is dropped by the pivoted solve, as a rank-deficient fit does.

Spark computes one Gram matrix per (series, a, b) with a grouped aggregate and
sweeps it in the same row (``operators/matrix.py``). Fitted values and forecasts are
Spark expressions with the coefficients joined by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matrix import gram_sums, last, solve

TERMS = ["one", "s", "c", "p1", "p2", "p3", "sp1", "sp2", "sp3", "cp1", "cp2", "cp3", "m"]
TOLERANCE, EXACT = 1e-5, 1e-9      # series of 30 periods or more keep every independent term
# Frequency pairs (a, b) tried by the reference, one per modelled series.
FREQ_PAIRS = [(0.6, 0.5), (0.6, 0.3), (0.5, 0.6), (0.5, 0.5)]


def term_columns(idx: Column, n_train: Column, fa: Column, fb: Column) -> list[Column]:
    m = idx.cast("double")
    u = (F.lit(2.0) * m - (n_train + F.lit(1.0))) / F.greatest(n_train - F.lit(1.0), F.lit(1.0))
    s, c = F.sin(fa * m), F.cos(fb * m)
    p1, p2, p3 = u, u * u, u * u * u
    return [F.lit(1.0), s, c, p1, p2, p3, s * p1, s * p2, s * p3, c * p1, c * p2, c * p3, m]


def fit_grid(train: DataFrame, series: str = "series", idx: str = "idx", value: str = "value",
             pairs=FREQ_PAIRS) -> DataFrame:
    """T5 + T5b: one fit per (series, a, b) -> (series, fa, fb, coef[13], rss, n, rank).

    A term of which those before it leave less than TOLERANCE is dropped: its coefficient is 0 and the rank
    lower. A short series that the terms explain whole has a residual sum of 0."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("fa"), F.lit(float(b)).alias("fb"))
                               for a, b in pairs]))
    n = F.count(F.lit(1)).over(Window.partitionBy(series))
    x = (train.select(F.col(series).alias("series"), F.col(idx).alias("idx"),
                      F.col(value).cast("double").alias("y"))
              .withColumn("n_train", n.cast("double"))
              .select("*", grid.alias("__g")).select("series", "idx", "y", "n_train", "__g.fa", "__g.fb"))
    cols = term_columns(F.col("idx"), F.col("n_train"), F.col("fa"), F.col("fb")) + [F.col("y")]
    x = x.select("series", "fa", "fb", *[c.alias(f"t{i}") for i, c in enumerate(cols)])
    g = x.groupBy("series", "fa", "fb").agg(gram_sums([F.col(f"t{i}") for i in range(len(cols))]).alias("g"), F.count(F.lit(1)).alias("n"))
    fit = g.select("series", "fa", "fb", "n", solve(F.col("g"), F.sequence(F.lit(0), F.lit(len(TERMS) - 1)), TOLERANCE).alias("s"),
                   last(last(F.col("g"))).alias("yy"))
    return fit.select("series", "fa", "fb", F.transform("s.coef", lambda v: F.coalesce(v, F.lit(0.0))).alias("coef"),
                      F.when(F.col("s.rss") > EXACT * F.col("yy"), F.col("s.rss")).otherwise(0.0).alias("rss"), "n", F.col("s.rank").alias("rank"))


def choose(fits: DataFrame) -> DataFrame:
    """The frequency pair with the lowest residual sum of squares per series."""
    best = F.min_by(F.struct("fa", "fb", "coef", "rss", "n", "rank"), F.struct("rss", "fa", "fb"))
    return fits.groupBy("series").agg(best.alias("b")).select("series", "b.*")


def evaluate(rows: DataFrame, chosen: DataFrame, series: str = "series", idx: str = "idx",
             name: str = "trend_fit") -> DataFrame:
    """Fitted values (training idx) and forecasts (later idx) from the chosen
    coefficients; the polynomial scaling uses the training length."""
    j = rows.join(chosen.select(F.col("series").alias(series), "fa", "fb", "coef",
                                F.col("n").cast("double").alias("__n")), series)
    terms = term_columns(F.col(idx), F.col("__n"), F.col("fa"), F.col("fb"))
    pred = F.lit(0.0)
    for i, t in enumerate(terms):
        pred = pred + F.get(F.col("coef"), i) * t
    return j.withColumn(name, pred).drop("fa", "fb", "coef", "__n")
