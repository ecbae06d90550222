"""Grouped aggregates, scores and chart tables.

Global statistics (min/max, mean/sd of a score) are one-row aggregates whose
values come back to the driver and enter the next step as literals: never an
unpartitioned window over the data, never a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGG_FUNCS = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "sd": F.stddev_samp, "min": F.min,
    "max": F.max, "count": F.count, "median": F.median,
}


def agg_by_name(name: str):
    """D3: aggregate passed by name (``sum | mean | sd ...``) -> Spark function."""
    try:
        return AGG_FUNCS[name]
    except KeyError as exc:
        raise ValueError(f"unknown aggregate {name!r}") from exc


def in_open_range(col: str | Column, lo: float, hi: float) -> Column:
    """Strict range ``lo < x < hi`` (the ends are excluded)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c > F.lit(lo)) & (c < F.lit(hi))


def group_means(df: DataFrame, key: str, value: str, only: Sequence | None = None,
                name: str = "mean_amount") -> DataFrame:
    """A5: mean of one measure per category, for the named categories only."""
    src = df.where(F.col(key).isin(list(only))) if only is not None else df
    return src.groupBy(key).agg(F.avg(value).alias(name), F.count(F.lit(1)).alias("n"))


def group_aggregate(df: DataFrame, keys: Sequence[str], measures: dict[str, str],
                    fun: str = "sum", drop_null_keys: bool = False) -> DataFrame:
    """One grouped aggregate for many measures.

    ``drop_null_keys`` reproduces ``aggregate(..., by=)`` which drops rows with a
    missing key (N4); plain group-by keeps a NULL group (N3).
    """
    f = agg_by_name(fun)
    src = df.dropna(subset=list(keys)) if drop_null_keys else df
    return src.groupBy(*keys).agg(*[f(c).alias(out) for out, c in measures.items()])


def totals_on_rows(df: DataFrame, keys: Sequence[str], value: str,
                   total: str = "total_invest", count: str = "number_of_investments",
                   max_groups: int = 1_000_000) -> DataFrame:
    """Group sum and count attached to every detail row.

    Not a window: a window would shuffle every detail row to its group's task,
    so one hot group would land in one task. Instead the totals are a partial
    (map-side combined) aggregate, kept once, and joined back; the join is a
    broadcast when the number of groups is under a checked bound (no shuffle of
    the detail rows), else a null-safe hash join left to AQE's skew handling.
    """
    from tessera.operators.relate import maybe_broadcast
    from tessera.session import materialize

    tot = (df.groupBy(*keys).agg(F.sum(value).alias(total), F.count(F.lit(1)).alias(count))
             .select(*[F.col(k).alias(f"__k_{k}") for k in keys], total, count))
    t = maybe_broadcast(materialize(tot), max_groups)
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(t[f"__k_{k}"])
        cond = c if cond is None else cond & c
    return df.join(t, cond, "inner").drop(*[f"__k_{k}" for k in keys])


def stability(df: DataFrame, key: str, value: str) -> DataFrame:
    """A12 + A13: mean, sample sd, total and coefficient of variation sd/|mean|."""
    return (df.groupBy(key)
              .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                   F.sum(value).alias("total"))
              .withColumn("cv_abs", F.try_divide(F.col("sd"), F.abs(F.col("mean")))))


def standard_scores(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """``(x - mean) / sd_samp`` over all rows for each column (``out: in``)."""
    st = df.agg(*[e for c in cols.values()
                  for e in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))]).first()

    def lit(v):
        return F.lit(None).cast("double") if v is None else F.lit(float(v))

    return df.withColumns({o: F.try_divide(F.col(c) - lit(st[f"__m_{c}"]), lit(st[f"__s_{c}"])) for o, c in cols.items()})


def segment_scores(stab: DataFrame, cv: str = "cv_abs", profit: str = "total",
                   w_cv: float = 0.5, w_profit: float = 0.5) -> DataFrame:
    """W1 + W2: standardised CV and profit, then ``weighted`` and ``weighted_v1``.

    The table has a row a segment; it is kept once, since its means and standard deviations are read
    before its rows.
    """
    from tessera.session import materialize

    z = standard_scores(materialize(stab), {"cv_norm": cv, "profit_norm": profit})
    return weighted_scores(z, w_cv=w_cv, w_profit=w_profit)


def weighted_scores(z: DataFrame, cv: str = "cv_norm", profit: str = "profit_norm",
                    w_cv: float = 0.5, w_profit: float = 0.5) -> DataFrame:
    """``weighted = w z_cv + w z_profit`` and ``weighted_v1 = w (1 - z_cv) + w z_profit``
    (a low CV is better, so the second form rewards it)."""
    return z.withColumns({
        "weighted": F.col(cv) * w_cv + F.col(profit) * w_profit,
        "weighted_v1": (F.lit(1) - F.col(cv)) * w_cv + F.col(profit) * w_profit,
    })


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``bins`` equal bins centred on min and max (width = range/(bins-1)),
    right-closed, as a chart library draws them -> (bin, lo, hi, n)."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, hi = F.lit(float(r["lo"])), F.lit(float(r["hi"]))
    w = (hi - lo) / F.lit(bins - 1)
    b = F.ceil((F.col(col) - lo) / w - F.lit(0.5))
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)))
    return (df.where(F.col(col).isNotNull())
              .withColumn("bin", b.cast("int"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
              .select("bin", (lo + (F.col("bin") - F.lit(0.5)) * w).alias("lo"),
                      (lo + (F.col("bin") + F.lit(0.5)) * w).alias("hi"), "n"))


def box_stats(df: DataFrame, groups: Sequence[str], col: str) -> DataFrame:
    """Quartiles (type 7), whiskers at 1.5 IQR, outlier count per group.

    Exact quartiles with bounded memory (quantile.py), then a conditional
    aggregate over the rows joined with their group's fences (one row per group,
    broadcast under a checked bound).
    """
    from tessera.operators.quantile import exact_quantiles
    from tessera.operators.relate import maybe_broadcast
    from tessera.session import materialize

    src = df.where(F.col(col).isNotNull())
    q = (exact_quantiles(src, groups, col, [0.25, 0.5, 0.75])
         .select(*groups, F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3")))
    iqr = F.col("q3") - F.col("q1")
    fences = materialize(q.withColumns({"__flo": F.col("q1") - 1.5 * iqr, "__fhi": F.col("q3") + 1.5 * iqr}))
    inside = (F.col(col) >= F.col("__flo")) & (F.col(col) <= F.col("__fhi"))
    return (src.join(maybe_broadcast(fences), on=list(groups), how="inner")
               .groupBy(*groups, "q1", "median", "q3")
               .agg(F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
                    F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
                    F.sum((~inside).cast("long")).alias("n_outliers"),
                    F.count(F.lit(1)).alias("n")))


def binned_trend(df: DataFrame, bin_col: str | Column, y: str, span: int = 1) -> DataFrame:
    """Mean, n and standard error of ``y`` per bin, plus a centred moving
    mean over ``2*span+1`` neighbouring bins (the table behind a smooth line).

    The moving mean runs on the aggregated bins only (one row per bin).
    """
    b = F.col(bin_col) if isinstance(bin_col, str) else bin_col
    per_bin = (df.where(F.col(y).isNotNull()).groupBy(b.alias("bin"))
                 .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
                      F.stddev_samp(y).alias("__sd")))
    w = Window.orderBy("bin").rowsBetween(-span, span)
    return per_bin.select("bin", "n", "mean",
                          (F.col("__sd") / F.sqrt(F.col("n"))).alias("se"),
                          F.avg("mean").over(w).alias("moving_mean"))


def quantile_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """``y`` over bins cut at the exact quantiles of ``x``: bin, n, lo and hi of
    x, mean of y and its standard error. Values equal to a cut go to the bin below.

    The cuts are ``bins - 1`` numbers, brought back and put in as literals.
    """
    from tessera.operators.quantile import exact_quantiles

    src = df.where(F.col(x).isNotNull())
    row = exact_quantiles(src, [], x, [k / bins for k in range(1, bins)]).first()
    cuts = [row[f"q_{k}"] for k in range(bins - 1)] if row else []
    b = sum((F.when(F.col(x) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return (src.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(y).alias("mean"),
        F.try_divide(F.stddev_samp(y), F.sqrt(F.count(y))).alias("se")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of every pair from one aggregate over the
    complete rows -> (row_var, col_var, corr, n_complete)."""
    cols = list(cols)
    comp = df.select(*cols).dropna()
    exprs = [F.count(F.lit(1)).alias("__n")]
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            key = f"c_{i}_{j}"
            pairs.append((a, b, key))
            if i < j:
                exprs.append(F.corr(a, b).alias(key))
    wide = comp.agg(*exprs)

    def val(i, j):
        if i == j:
            return F.lit(1.0)
        lo, hi = min(i, j), max(i, j)
        return F.col(f"c_{lo}_{hi}")

    stack = F.explode(F.array(*[
        F.struct(F.lit(a).alias("row_var"), F.lit(b).alias("col_var"), val(i, j).alias("corr"))
        for i, a in enumerate(cols) for j, b in enumerate(cols)]))
    return wide.select(F.col("__n").alias("n_complete"), stack.alias("s")).select(
        "s.row_var", "s.col_var", "s.corr", "n_complete")
