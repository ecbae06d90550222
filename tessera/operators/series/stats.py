"""Series statistics for many series at once.

Lagged cross products come from a join of each observation with the one
``k`` periods later (k = 1..K per series), shuffled on the series key; sums
are grouped by (series, k). No per-series Python for ACF, KPSS or Ljung-Box.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matrix import gram_sums, last, let, solve

# KPSS level-stationarity critical values and their p-values.
KPSS_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]

# Dickey-Fuller critical values, regression with constant and
# trend (Fuller 1976), rows by sample size, columns by p-value.
ADF_T = [25, 50, 100, 250, 500, 100000]
ADF_P = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
ADF_CRIT = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]


def lags(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value",
         k: int = 2) -> DataFrame:
    """Lagged values and the first difference within each series."""
    w = Window.partitionBy(series).orderBy(idx)
    out = df.withColumns({f"lag{i}": F.lag(value, i).over(w) for i in range(1, k + 1)})
    return out.withColumn("diff1", F.col(value) - F.col("lag1"))


def _deviations(df, series, idx, value):
    w = Window.partitionBy(series)
    return df.select(series, idx, F.col(value).cast("double").alias("x"),
                     (F.col(value) - F.avg(value).over(w)).alias("d"),
                     F.count(F.lit(1)).over(w).alias("n"))


def lag_products(dev: DataFrame, series: str, idx: str, col: str, max_lag: Column) -> DataFrame:
    """sum_t col_t * col_{t+k} for k = 1..max_lag(series) -> (series, lag, s).

    ``dev`` needs (series, idx, col) and the columns used by ``max_lag``.
    """
    left = (dev.where(max_lag >= 1)
               .select(series, idx, F.col(col).alias("__a"),
                       F.explode(F.sequence(F.lit(1), max_lag.cast("int"))).alias("lag")))
    left = left.withColumn("__j", F.col(idx) + F.col("lag"))
    right = dev.select(F.col(series).alias("__s2"), F.col(idx).alias("__j2"), F.col(col).alias("__b"))
    j = left.join(right, (F.col(series) == F.col("__s2")) & (F.col("__j") == F.col("__j2")))
    return j.groupBy(series, "lag").agg(F.sum(F.col("__a") * F.col("__b")).alias("s"))


def acf_lag_max(n: Column) -> Column:
    """Default number of lags: floor(10 log10 n), at most n - 1."""
    return F.least(F.floor(F.lit(10.0) * F.log10(n)), n - 1).cast("int")


def acf(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value",
        lag_max: int | None = None) -> DataFrame:
    """Autocorrelation r_k = sum d_t d_{t+k} / sum d_t^2 -> (series, lag, acf, n)."""
    dev = _deviations(df, series, idx, value)
    kmax = F.lit(lag_max) if lag_max is not None else acf_lag_max(F.col("n"))
    dev = dev.withColumn("__k", F.least(kmax, F.col("n") - 1))
    prods = lag_products(dev, series, idx, "d", F.col("__k"))
    c0 = dev.groupBy(series).agg(F.sum(F.col("d") * F.col("d")).alias("c0"), F.first("n").alias("n"))
    return (prods.join(c0, series)
                 .select(series, "lag", F.try_divide(F.col("s"), F.col("c0")).alias("acf"), "n"))


def pacf_from_acf(r: Column) -> Column:
    """Durbin-Levinson as one fold: partial autocorrelations from the array r_1..r_K."""
    none = F.array().cast("array<double>")
    zero = F.struct(none.alias("phi"), F.lit(1.0).alias("v"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        k = F.size(s["phi"])
        # phi_j meets r_{k - j + 1}: the last k autocorrelations used so far, newest first
        seen = F.aggregate(F.zip_with(s["phi"], F.reverse(F.slice(r, 1, k)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        a = F.when(s["v"] > 0, (x - seen) / F.nullif(s["v"], F.lit(0.0))).otherwise(0.0)
        return let(a, lambda v: F.struct(
            F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda p, q: p - v * q), F.array(v)).alias("phi"),
            (s["v"] * (1.0 - v * v)).alias("v"), F.concat(s["out"], F.array(v)).alias("out")))

    return F.aggregate(r, zero, step, lambda s: s["out"])


def pacf(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value",
         lag_max: int | None = None) -> DataFrame:
    """Partial autocorrelations: one row of K autocorrelations a series, folded in place."""
    rows = acf(df, series, idx, value, lag_max).groupBy(series).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("a"))
    out = rows.select(series, F.posexplode(pacf_from_acf(F.col("a.acf"))).alias("k", "pacf"))
    return out.select(series, (F.col("k") + 1).cast("int").alias("lag"), "pacf")


def kpss_lag(n: Column) -> Column:
    """Short truncation lag: trunc(3 sqrt(n) / 13)."""
    return F.floor(F.lit(3.0) * F.sqrt(n) / F.lit(13.0)).cast("int")


def _interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear interpolation, clamped at both ends (xs increasing)."""
    out = F.when(x <= F.lit(xs[0]), F.lit(ys[0]))
    for i in range(len(xs) - 1):
        x0, x1, y0, y1 = xs[i], xs[i + 1], ys[i], ys[i + 1]
        out = out.when(x <= F.lit(x1), F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(ys[-1]))


def kpss(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value") -> DataFrame:
    """KPSS level statistic with Bartlett long-run variance and short lag;
    p by interpolation of the critical values, clamped to [0.01, 0.10]."""
    dev = _deviations(df, series, idx, value)
    w = Window.partitionBy(series).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    dev = dev.withColumns({"cs": F.sum("d").over(w), "__l": kpss_lag(F.col("n"))})
    base = dev.groupBy(series).agg(
        F.first("n").alias("n"), F.first("__l").alias("lag"),
        F.sum(F.col("cs") * F.col("cs")).alias("ss_cs"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    prods = lag_products(dev, series, idx, "d", F.col("__l"))
    bart = (prods.join(base.select(series, F.col("lag").alias("__L")), series)
                 .groupBy(series)
                 .agg(F.sum((F.lit(1.0) - F.col("lag") / (F.col("__L") + 1)) * F.col("s")).alias("bw")))
    out = base.join(bart, series, "left").withColumn("bw", F.coalesce("bw", F.lit(0.0)))
    s2 = F.col("ss") / F.col("n") + F.lit(2.0) * F.col("bw") / F.col("n")
    stat = F.try_divide(F.col("ss_cs") / (F.col("n") * F.col("n")), s2)    # NULL for a constant series
    out = out.select(series, "n", "lag", stat.alias("kpss_stat"))
    # p falls as the statistic rises: interpolate on the increasing critical values
    return out.withColumn("p_value", _interp(F.col("kpss_stat"), KPSS_CRIT, KPSS_P))


def ljung_box(acf_df: DataFrame, series: str = "series", h: int = 10) -> DataFrame:
    """Q = n (n + 2) sum_{k<=h} r_k^2 / (n - k), h capped at n - 1."""
    a = acf_df.where(F.col("lag") <= F.least(F.lit(h), F.col("n") - 1))
    return a.groupBy(series).agg(
        F.max("lag").alias("h"),
        (F.first("n") * (F.first("n") + 2)
         * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q_stat"))


def ljung_box_p(q: Column, h: Column, fitdf: int = 0) -> Column:
    """Upper chi-square tail of Q with h - fitdf degrees of freedom."""
    return chi2_sf(q, h - fitdf)


# ----------------------------------------------------------------- p-values
def _erfc_root(x: Column) -> Column:
    """erfc(sqrt(x)) for x >= 0: below 2 one less the series of erf, from 2 on its continued fraction."""
    steps = F.sequence(F.lit(1), F.lit(60))
    series = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                         lambda a, k: let(a["t"] * x / (k + 0.5), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))), lambda a: a["s"])
    # erfc(z) = exp(-z^2) / sqrt(pi) / (z + (1/2) / (z + 1 / (z + (3/2) / (z + ...)))), from the inside out
    z = F.sqrt(x)
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda a, k: z + (k / 2.0) / a)
    return F.when(x < 2, 1.0 - 2.0 / math.sqrt(math.pi) * F.sqrt(x) * F.exp(-x) * series) \
        .otherwise(F.exp(-x) / math.sqrt(math.pi) / fraction)


def chi2_sf(q: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution, by its finite sums: Q_1 is
    erfc(sqrt(q / 2)), Q_2 is exp(-q / 2), and two more degrees of freedom add
    exp(-q / 2) (q / 2)^(df / 2) / Gamma(df / 2 + 1). Null without a degree of freedom."""
    x, even = q / 2.0, df % 2 == 0
    # The first term to add: x / Gamma(2) for an even number, x^(1/2) / Gamma(3/2) for an odd one.
    first = F.struct(F.lit(0.0).alias("s"), F.when(even, x).otherwise(F.sqrt(x) * 2.0 / math.sqrt(math.pi)).alias("t"))
    have = F.when(even, F.lit(2)).otherwise(F.lit(1))
    more = F.when(df > have, F.sequence(have, df - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    added = F.aggregate(more, first, lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * x / (k / 2.0 + 1.0)).alias("t")), lambda a: a["s"])
    tail = F.when(even, F.exp(-x)).otherwise(_erfc_root(x)) + F.exp(-x) * added
    return F.when((df > 0) & (q <= 0), F.lit(1.0)).when((df > 0) & q.isNotNull(), F.least(tail, F.lit(1.0)))


def adf_p_value(stat: Column, n: Column) -> Column:
    """Interpolate the critical values at sample size n, then the p-value at
    ``stat``; clamped to [0.01, 0.99]."""
    crit = [_interp(n, [float(t) for t in ADF_T], [row[j] for row in ADF_CRIT]) for j in range(len(ADF_P))]
    out = F.when(stat <= crit[0], F.lit(ADF_P[0]))
    for a, b, x0, x1 in zip(ADF_P, ADF_P[1:], crit, crit[1:]):
        out = out.when(stat <= x1, F.lit(a) + (stat - x0) * (b - a) / (x1 - x0))
    return F.when(stat.isNotNull(), out.otherwise(F.lit(ADF_P[-1])))


def adf_lag(n: Column) -> Column:
    """Default number of lagged differences: trunc((n - 1)^(1/3))."""
    return F.floor(F.pow((n - 1).cast("double"), F.lit(1.0 / 3.0))).cast("int")


def adf(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value",
        k: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller t-ratio of every series: the change regressed on a constant, a trend, the
    level before and ``k`` changes before (default ``adf_lag``) -> (series, n, lag_order, adf_stat, p_value).

    One Gram row a series, as wide as the largest lag order asks for, swept in place. Series too short for
    the regression, or left without a residual, have null results."""
    own, whole = Window.partitionBy(series).orderBy(idx), Window.partitionBy(series)
    x = F.col("x")
    rows = df.select(F.col(series), F.col(idx), F.col(value).cast("double").alias("x")) \
        .select(series, idx, (x - F.avg("x").over(whole)).alias("x"), F.row_number().over(own).alias("at"),
                F.count("*").over(whole).alias("n"), (x - F.lag("x").over(own)).alias("y"))
    rows = rows.withColumn("lag_order", F.lit(k) if k is not None else adf_lag(F.col("n")))
    top = k if k is not None else rows.agg(F.max("lag_order")).first()[0] or 0
    # A column a lagged change; 0 beyond the series' own order, so that it never enters.
    before = [F.when(F.col("lag_order") >= j, F.lag("y", j).over(own)).otherwise(0.0).alias(f"y{j}") for j in range(1, top + 1)]
    rows = rows.select("*", F.lag("x").over(own).alias("level"), *before).where(F.col("at") >= F.col("lag_order") + 2)
    terms = [F.lit(1.0), F.col("level"), F.col("at") - F.col("n") / 2.0, *[F.col(f"y{j}") for j in range(1, top + 1)], F.col("y")]
    g = rows.groupBy(series, "n", "lag_order").agg(F.count("*").alias("rows"), gram_sums(terms).alias("g"))
    fit = g.withColumn("s", solve(F.col("g"), F.sequence(F.lit(0), F.lit(len(terms) - 2))))
    # What rounding leaves of the change's sum of squares is no residual.
    left = F.when(F.col("s.rss") > 1e-12 * last(last(F.col("g"))), F.col("s.rss"))
    stat = F.try_divide(F.get("s.coef", F.lit(1)), F.sqrt(left / F.nullif(F.col("rows") - F.col("s.rank"), F.lit(0)) * F.get("s.inverse", F.lit(1))))
    enough = F.col("n") - 1 - F.col("lag_order") >= F.col("lag_order") + 4
    out = fit.select(series, "n", "lag_order", F.when(enough, stat).alias("adf_stat"))
    every = df.groupBy(series).agg(F.count("*").alias("n"))       # also those without a row for the regression
    every = every.withColumn("lag_order", F.lit(k) if k is not None else adf_lag(F.col("n")))
    out = every.join(out.select(series, "adf_stat"), series, "left")
    return out.withColumn("p_value", adf_p_value(F.col("adf_stat"), F.col("n") - 1))
