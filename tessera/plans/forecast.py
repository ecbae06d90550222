"""Sales forecasting workload: segment x month rollup, segment ranking, and the
series models - for every segment and measure in one job over a ``series`` key
(the reference repeats one script body per chosen series)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.dates import parse_dmy, year_month
from tessera.functions.text import paste
from tessera.operators.aggregate import group_aggregate, segment_scores, stability
from tessera.operators.reshape import add_index, fill_month_gaps, holdout_split, measures_to_series
from tessera.operators.series import accuracy, acf, adf, best_model, kpss, lags, ljung_box, pacf, trend
from tessera.operators.series import ses_fitted, ses_grid, ses_levels
from tessera.operators.series.arima import MODEL_COLS, apply_model, arima
from tessera.operators.series.stats import ADF_CRIT, ADF_P, ADF_T, chi2_sf, ljung_box_p
from tessera.operators.series.trend import FREQ_PAIRS, TERMS, choose, evaluate, fit_grid
from tessera.operators.reshape import append_kind
from tessera.functions.numeric import rnd, rnd_sig, rnd_sig_sql
from tessera.plans import bind
from tessera.session import checkpoint_dir, materialize
from tessera.sources.files import read_slices, write_slices

MEASURES = ["sales", "quantity"]
HORIZON = 6
ALPHA = 0.5
ALPHAS = [0.2, 0.3, 0.5, 0.7]
LB_LAGS = 10
TOP_SEGMENTS = 2


# ------------------------------------------------------------------ operators
# The column that the NULL profile (query null_profile) shows to be mostly NULL.
MOSTLY_NULL = ["Postal_Code"]


def clean_store(store: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Drop the mostly-NULL columns, parse the text dates, build month and segment keys.

    Which columns go is known by name; ``drop_mostly_null`` finds them on new data,
    with a pass of its own over all columns.
    """
    s = store.drop(*(MOSTLY_NULL if drop is None else drop))
    return s.withColumns({
        "order_dt": parse_dmy("Order_Date"),
        "ship_dt": parse_dmy("Ship_Date"),
    }).withColumns({
        "month": year_month("order_dt"),
        "market_segment": paste("Market", "Segment", sep="-"),
    })


def monthly_rollup(clean: DataFrame) -> DataFrame:
    """A10: one grouped aggregate of the three measures per (segment, month);
    rows with a missing key are dropped first (N4)."""
    return group_aggregate(clean, ["market_segment", "month"],
                           {"sales": "Sales", "quantity": "Quantity", "profit": "Profit"},
                           "sum", drop_null_keys=True)


def series_table(rollup: DataFrame, measures=MEASURES, fill_gaps: bool = False) -> DataFrame:
    """R3 + T1 + F4: long (series, idx, value) for every segment and measure,
    indexed by month, with the holdout flag. By default missing months close up
    (the index counts present months, N15); ``fill_gaps`` inserts them as 0."""
    num = rollup.withColumns({m: F.col(m).cast("double") for m in measures})
    if fill_gaps:
        num = fill_month_gaps(num, "market_segment", "month", list(measures), 0.0)
    long = measures_to_series(num, "market_segment", "month", measures)
    idx = add_index(long, ["series"], ["month"])
    return holdout_split(idx, "series", "idx", HORIZON)


# ------------------------------------------------------------------ bindings
def _clean(spark, sf_dir):
    return clean_store(bind.store_view(spark, sf_dir))


def _rollup(spark, sf_dir):
    return monthly_rollup(_clean(spark, sf_dir))


def _series(spark, sf_dir):
    """The long series table, materialised once: it is small (series x periods)
    and every statistic below reads it several times (self-joins, per-series
    aggregates), which would otherwise re-run the whole rollup each time."""
    return materialize(series_table(_rollup(spark, sf_dir)))


def _train(spark, sf_dir):
    return _series(spark, sf_dir).where(~F.col("is_test"))


def q_parse_dates(spark, sf_dir):
    c = _clean(spark, sf_dir)
    return c.select("Row_ID", "order_dt", "ship_dt", "month")


def q_segment_month_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rollup(spark, sf_dir)
    return r.select("market_segment", "month", F.col("sales").cast("double").alias("sales"), "quantity",
                    F.col("profit").cast("double").alias("profit"))


def q_segment_totals(spark, sf_dir):
    t = group_aggregate(_clean(spark, sf_dir), ["market_segment"],
                        {"sales": "Sales", "quantity": "Quantity", "profit": "Profit"}, "sum", True)
    return t.select("market_segment", F.col("sales").cast("double").alias("sales"), "quantity",
                    F.col("profit").cast("double").alias("profit"))


def _stability(spark, sf_dir):
    return _segment_stability(_clean(spark, sf_dir))


def _segment_stability(clean: DataFrame) -> DataFrame:
    return stability(clean.dropna(subset=["market_segment"]), "market_segment", "Profit")


def q_segment_stability(spark, sf_dir):
    s = _stability(spark, sf_dir)
    return s.select("market_segment", rnd("mean", 4).alias("mean_profit"), rnd("sd", 4).alias("sd_profit"),
                    F.col("total").cast("double").alias("total_profit"), rnd("cv_abs", 6).alias("cv_abs"))


def q_segment_score(spark, sf_dir):
    sc = segment_scores(_stability(spark, sf_dir))
    sc = sc.withColumn("score_rank", F.row_number().over(
        Window.orderBy(F.col("weighted_v1").desc(), "market_segment")))   # one row per segment
    return sc.select("market_segment", rnd("cv_norm", 6).alias("cv_norm"),
                     rnd("profit_norm", 6).alias("profit_norm"),
                     rnd("weighted", 6).alias("weighted"), rnd("weighted_v1", 6).alias("weighted_v1"),
                     "score_rank")


def q_top_segments(spark, sf_dir):
    """A11 + W2: the monthly slices of the two segments with the best weighted score.

    The cleaned lines' keys and measures are written once, so that score and slices don't both join.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    lines = _clean(spark, sf_dir).select("market_segment", "month", "Sales", "Quantity", "Profit")
    lines.write.parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    sc = segment_scores(_segment_stability(lines))
    best = sc.orderBy(F.col("weighted_v1").desc(), "market_segment").limit(TOP_SEGMENTS).select("market_segment")
    r = monthly_rollup(lines).join(F.broadcast(best), "market_segment", "left_semi")        # two rows
    return r.select("market_segment", "month", F.col("sales").cast("double").alias("sales"), "quantity")


def q_slices_round_trip(spark, sf_dir):
    """S6 + S7: the top segments' slices written to the shared folder, a folder a slice, and read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/slices-{uuid.uuid4().hex}"
    write_slices(q_top_segments(spark, sf_dir), folder, ["market_segment"])
    return read_slices(spark, folder, "month string, sales double, quantity long, market_segment string") \
        .select("market_segment", "month", "sales", "quantity")


def q_ljung_box_lags(spark, sf_dir):
    """Q of the training series for every number of lags up to LB_LAGS."""
    a = acf(_train(spark, sf_dir)).where(F.col("lag") <= LB_LAGS)
    w = Window.partitionBy("series").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(w)
    return a.select("series", "lag", "acf", q.alias("q")).select(
        "series", "lag", rnd("acf", 6).alias("acf"), rnd("q", 4).alias("q_stat"), rnd(chi2_sf(F.col("q"), F.col("lag")), 6).alias("p_value"))


def q_standard_residuals(spark, sf_dir):
    """Residuals of the smoothed training series over their standard deviation."""
    s = ses_fitted(ses_levels(_train(spark, sf_dir), alpha=ALPHA))
    s = s.select("series", "idx", (F.col("value") - F.col("smoothed")).alias("e"))
    w = Window.partitionBy("series")
    return s.select("series", "idx", rnd(F.try_divide(F.col("e") - F.avg("e").over(w), F.stddev_samp("e").over(w)), 6).alias("std_residual"))


def q_series_index(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("series", "month", "idx", "value")


def q_holdout_split(spark, sf_dir):
    return _series(spark, sf_dir).select("series", "idx", "n_obs", "is_test")


def q_series_lags(spark, sf_dir):
    lg = lags(_series(spark, sf_dir), k=2)
    return lg.select("series", "idx", "lag1", "lag2", rnd("diff1", 4).alias("diff1"))


def _levels(spark, sf_dir):
    return ses_levels(_train(spark, sf_dir), alpha=ALPHA)


def q_ses_level(spark, sf_dir):
    return _levels(spark, sf_dir).select("series", "idx", rnd("level", 4).alias("level"))


def q_ses_grid(spark, sf_dir):
    g = ses_grid(_train(spark, sf_dir), ALPHAS)
    return g.select("series", "alpha", rnd(F.sqrt("mse"), 4).alias("rmse"), "n_errors")


def q_ses_fitted(spark, sf_dir):
    f = ses_fitted(_levels(spark, sf_dir))
    return f.select("series", "idx", rnd("smoothed", 4).alias("smoothed"))


def q_residuals(spark, sf_dir):
    """T7 with the smoother as the fitted series: raw training value minus the
    smoothed value (the trend + season residual is ``_Ctx.local``)."""
    f = ses_fitted(_levels(spark, sf_dir))
    return f.select("series", "idx", rnd(F.col("value") - F.col("smoothed"), 4).alias("residual"))


def q_acf(spark, sf_dir):
    a = acf(_train(spark, sf_dir))
    return a.select("series", "lag", rnd("acf", 6).alias("acf"))


def q_kpss_test(spark, sf_dir):
    k = kpss(_train(spark, sf_dir))
    return k.select("series", "n", "lag", rnd("kpss_stat", 6).alias("kpss_stat"),
                    rnd("p_value", 6).alias("p_value"))


def q_ljung_box(spark, sf_dir):
    lb = ljung_box(acf(_train(spark, sf_dir)), h=LB_LAGS)
    return lb.select("series", "h", rnd("q_stat", 4).alias("q_stat"))


def q_forecast_accuracy(spark, sf_dir):
    """T15 on the naive forecast: every test month is forecast by the last training value."""
    s = _series(spark, sf_dir)
    last = (s.where(~F.col("is_test")).groupBy("series")
              .agg(F.max_by("value", "idx").alias("forecast")))
    test = s.where(F.col("is_test")).join(last, "series").withColumnRenamed("value", "actual")
    a = accuracy(test, ["series"])
    return a.select("series", *[rnd(c, 6).alias(c) for c in ["me", "rmse", "mae", "mpe", "mape"]], "n_test")


QUERIES = {
    "parse_dates": q_parse_dates,
    "segment_month_rollup": q_segment_month_rollup,
    "segment_totals": q_segment_totals,
    "segment_stability": q_segment_stability,
    "segment_score": q_segment_score,
    "top_segments": q_top_segments,
    "slices_round_trip": q_slices_round_trip,
    "ljung_box_lags": q_ljung_box_lags,
    "standard_residuals": q_standard_residuals,
    "series_index": q_series_index,
    "holdout_split": q_holdout_split,
    "series_lags": q_series_lags,
    "ses_level": q_ses_level,
    "ses_grid": q_ses_grid,
    "ses_fitted": q_ses_fitted,
    "residuals": q_residuals,
    "acf": q_acf,
    "kpss_test": q_kpss_test,
    "ljung_box": q_ljung_box,
    "forecast_accuracy": q_forecast_accuracy,
}

# ------------------------------------------------------------------ models (rows-only checks)
class _Ctx:
    """One query's shared intermediates: the series table is built once and
    checkpointed (it is read by several model branches), the rest derives from it."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict = {}

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def series(self):
        return self._get("series", lambda: _series(self.spark, self.sf_dir))

    def train(self):
        return self._get("train", lambda: self.series().where(~F.col("is_test")))

    def smoothed(self):
        """T4: smoothed training series (level after each value; last one repeated)."""
        return self._get("smoothed", lambda: ses_fitted(ses_levels(self.train(), alpha=ALPHA))
                         .select("series", "idx", F.col("smoothed").alias("value")))

    def trend(self):
        def build():
            fits = materialize(fit_grid(self.smoothed()))
            return fits, choose(fits)
        return self._get("trend", build)

    def trend_path(self):
        """Trend + season values on every period (fitted on train, forecast on test)."""
        return self._get("trend_path", lambda: evaluate(self.series(), self.trend()[1]))

    def local(self):
        """Raw training value minus the trend + season fit."""
        return self._get("local", lambda: self.trend_path().where(~F.col("is_test"))
                         .select("series", "idx", (F.col("value") - F.col("trend_fit")).alias("value")))

    def arima_raw(self):
        return self._get("arima_raw", lambda: arima(self.train(), h=HORIZON))

    def arima_both(self):
        """(models, path) by ``target``: the raw training series and the residual of trend + season, as one job."""
        def build():
            key = F.concat_ws(":", "target", "series")
            both = self.train().select("series", "idx", "value", F.lit("raw").alias("target")) \
                .unionByName(self.local().withColumn("target", F.lit("trend_residual")))
            apart = {"target": F.substring_index("key", ":", 1), "series": F.expr("substring(key, locate(':', key) + 1)")}
            models, path = arima(both.select(key.alias("key"), "idx", "value"), series="key", h=HORIZON)
            return models.withColumns(apart).drop("key"), path.withColumns(apart).drop("key")
        return self._get("arima_both", build)


def q_trend_season_grid(spark, sf_dir):
    fits, chosen = _Ctx(spark, sf_dir).trend()
    pick = chosen.select("series", F.col("fa").alias("__fa"), F.col("fb").alias("__fb"))
    return (fits.join(pick, "series")
                .select("series", "fa", "fb", rnd_sig("rss", 6).alias("rss"), "rank", "n",
                        ((F.col("fa") == F.col("__fa")) & (F.col("fb") == F.col("__fb"))).alias("chosen")))


def q_trend_season_fit(spark, sf_dir):
    _, chosen = _Ctx(spark, sf_dir).trend()
    z = F.arrays_zip(F.array(*[F.lit(t) for t in TERMS]).alias("term"), F.col("coef").alias("coef"))
    return chosen.select("series", "fa", "fb", "rss", F.explode(z).alias("z")).select(
        "series", "fa", "fb", F.col("z.term").alias("term"), rnd_sig("z.coef", 6).alias("coef"), rnd_sig("rss", 6).alias("rss"))


def q_trend_season_forecast(spark, sf_dir):
    return _Ctx(spark, sf_dir).trend_path().select("series", "idx", "is_test", "value", rnd_sig("trend_fit", 6).alias("trend_fit"))


def q_pacf(spark, sf_dir):
    """Partial autocorrelations of every training series."""
    return pacf(_train(spark, sf_dir)).select("series", "lag", rnd("pacf", 6).alias("pacf"))


def q_adf_test(spark, sf_dir):
    a = adf(_train(spark, sf_dir))
    return a.select("series", "n", "lag_order", rnd_sig("adf_stat", 7).alias("adf_stat"), rnd("p_value", 6).alias("p_value"))


def q_arima_select(spark, sf_dir):
    """T10 + T11: order, estimates, criteria and status of the raw series and of the residual of trend + season."""
    return _Ctx(spark, sf_dir).arima_both()[0].select("series", "target", *MODEL_COLS)


def q_arima_forecast(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    fc = c.arima_raw()[1].where(F.col("kind") == "forecast")
    act = c.series().where(F.col("is_test")).select("series", "idx", F.col("value").alias("actual"))
    return fc.join(act, ["series", "idx"], "left").select("series", "idx", F.col("value").alias("forecast"), "std_error", "actual")


# A model of second-order autoregression and first-order moving average on first differences, for the check of the
# recursions alone.
GIVEN = {"d": 1, "const": 0.0, "ar": [0.4, -0.25], "ma": [-0.6]}


def q_arima_given(spark, sf_dir):
    """Fitted values and forecasts with standard errors of every training series at given coefficients."""
    return apply_model(_train(spark, sf_dir), **GIVEN, h=HORIZON).select(
        "series", "idx", "kind", rnd_sig("value", 8).alias("value"), rnd_sig("std_error", 8).alias("std_error"))


def _white_noise(values, path):
    """ADF, KPSS, Ljung-Box and standardised extremes of the values minus the path's fitted ones."""
    res = (values.join(path.where(F.col("kind") == "fitted").select("series", "idx", F.col("value").alias("__f")),
                       ["series", "idx"])
                 .select("series", "idx", (F.col("value") - F.col("__f")).alias("value")))
    res = materialize(res)
    a = adf(res).select("series", "adf_stat", F.col("p_value").alias("adf_p"), "lag_order")
    k = kpss(res).select("series", "kpss_stat", F.col("p_value").alias("kpss_p"), F.col("lag").alias("kpss_lag"))
    lb = ljung_box(acf(res), h=LB_LAGS)
    lb = lb.withColumn("lb_p", ljung_box_p(F.col("q_stat"), F.col("h")))
    sd = res.groupBy("series").agg(F.stddev_samp("value").alias("resid_sd"),
                                   F.max(F.abs("value")).alias("max_abs_resid"))
    return (a.join(k, "series").join(lb, "series").join(sd, "series")
             .withColumn("max_std_resid", F.col("max_abs_resid") / F.col("resid_sd")))


def q_residual_tests(spark, sf_dir):
    """T13 + T14 + T18 on the residuals of trend + ARMA and of the ARIMA of the raw series: white-noise checks."""
    c = _Ctx(spark, sf_dir)
    path = c.arima_both()[1]
    left = _white_noise(c.local(), path.where("target = 'trend_residual'")).withColumn("model", F.lit("trend_arma"))
    raw = _white_noise(c.train().select("series", "idx", "value"), path.where("target = 'raw'")).withColumn("model", F.lit("arima"))
    return left.unionByName(raw)


def _test_accuracy(c: _Ctx):
    test = c.series().where(F.col("is_test")).select("series", "idx", F.col("value").alias("actual"))
    tr = c.trend_path().where(F.col("is_test")).select("series", "idx", F.col("trend_fit").alias("forecast"))
    ar = (c.arima_raw()[1].where(F.col("kind") == "forecast")
          .select("series", "idx", F.col("value").alias("forecast")))
    both = (test.join(tr, ["series", "idx"]).withColumn("model", F.lit("trend_season"))
                .unionByName(test.join(ar, ["series", "idx"]).withColumn("model", F.lit("arima"))))
    return accuracy(both, ["series", "model"])


def q_best_model(spark, sf_dir):
    return best_model(_test_accuracy(_Ctx(spark, sf_dir)))


def q_fit_and_forecast(spark, sf_dir):
    """Actual, trend + season and ARIMA values on one time axis."""
    c = _Ctx(spark, sf_dir)
    return append_kind({
        "actual": c.series().select("series", "idx", "value"),
        "trend_season": c.trend_path().select("series", "idx", F.col("trend_fit").alias("value")),
        "arima": c.arima_raw()[1].select("series", "idx", "value"),
    })


QUERIES.update({
    "trend_season_grid": q_trend_season_grid,
    "trend_season_fit": q_trend_season_fit,
    "trend_season_forecast": q_trend_season_forecast,
    "pacf": q_pacf,
    "adf_test": q_adf_test,
    "arima_select": q_arima_select,
    "arima_forecast": q_arima_forecast,
    "arima_given": q_arima_given,
    "residual_tests": q_residual_tests,
    "best_model": q_best_model,
    "fit_and_forecast": q_fit_and_forecast,
})


# ------------------------------------------------------------------ oracles
_CTE = f"""WITH RECURSIVE store_v AS ({bind.STORE_SQL}),
s AS (
  SELECT *, CAST(try_strptime(replace(Order_Date, '/', '-'), '%d-%m-%Y') AS DATE) AS order_dt,
         CAST(try_strptime(replace(Ship_Date, '/', '-'), '%d-%m-%Y') AS DATE) AS ship_dt,
         coalesce(Market, 'NA') || '-' || coalesce(Segment, 'NA') AS market_segment
  FROM store_v),
s2 AS (SELECT *, strftime(order_dt, '%Y-%m') AS month FROM s),
roll AS (
  SELECT market_segment, month, sum(Sales) AS sales, CAST(sum(Quantity) AS BIGINT) AS quantity, sum(Profit) AS profit
  FROM s2 WHERE market_segment IS NOT NULL AND month IS NOT NULL GROUP BY market_segment, month),
stab AS (
  SELECT market_segment, avg(Profit) AS mean, stddev_samp(Profit) AS sd, sum(Profit) AS total,
         stddev_samp(Profit) / abs(avg(Profit)) AS cv_abs
  FROM s2 WHERE market_segment IS NOT NULL GROUP BY market_segment),
z AS (
  SELECT market_segment, (cv_abs - avg(cv_abs) OVER ()) / stddev_samp(cv_abs) OVER () AS cv_norm,
         (total - avg(total) OVER ()) / stddev_samp(total) OVER () AS profit_norm FROM stab),
long AS (
  SELECT market_segment || ':sales' AS series, month, CAST(sales AS DOUBLE) AS value FROM roll
  UNION ALL SELECT market_segment || ':quantity' AS series, month, CAST(quantity AS DOUBLE) AS value FROM roll),
ser AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) AS idx,
         count(*) OVER (PARTITION BY series) AS n_obs FROM long),
ser2 AS (SELECT *, idx > n_obs - {HORIZON} AS is_test FROM ser),
tr AS (SELECT series, idx, value FROM ser2 WHERE NOT is_test),
ses(series, idx, value, level) AS (
  SELECT series, idx, value, value FROM tr WHERE idx = 1
  UNION ALL
  SELECT t.series, t.idx, t.value, {ALPHA} * t.value + (1 - {ALPHA}) * r.level
  FROM ses r JOIN tr t ON t.series = r.series AND t.idx = r.idx + 1),
alphas AS (SELECT CAST(unnest([{', '.join(str(a) for a in ALPHAS)}]) AS DOUBLE) AS alpha),
sesg(series, alpha, idx, value, level) AS (
  SELECT series, alpha, idx, value, value FROM tr, alphas WHERE idx = 1
  UNION ALL
  SELECT t.series, r.alpha, t.idx, t.value, r.alpha * t.value + (1 - r.alpha) * r.level
  FROM sesg r JOIN tr t ON t.series = r.series AND t.idx = r.idx + 1),
fit AS (
  SELECT series, idx, value,
         CASE WHEN idx = max(idx) OVER (PARTITION BY series) AND idx > 1
              THEN lag(level) OVER (PARTITION BY series ORDER BY idx) ELSE level END AS smoothed
  FROM ses),
dev AS (
  SELECT series, idx, value - avg(value) OVER (PARTITION BY series) AS d,
         count(*) OVER (PARTITION BY series) AS n FROM tr),
kk AS (SELECT DISTINCT series, n, least(CAST(floor(10 * log10(n)) AS BIGINT), n - 1) AS k,
              CAST(floor(3 * sqrt(n) / 13) AS BIGINT) AS l FROM dev),
prods AS (
  SELECT a.series, b.idx - a.idx AS lag, sum(a.d * b.d) AS s
  FROM dev a JOIN dev b ON a.series = b.series AND b.idx > a.idx
  JOIN kk ON kk.series = a.series AND b.idx - a.idx <= greatest(kk.k, kk.l)
  GROUP BY a.series, b.idx - a.idx),
c0 AS (SELECT series, sum(d * d) AS c0, any_value(n) AS n FROM dev GROUP BY series),
acfv AS (
  SELECT p.series, p.lag, p.s / c0.c0 AS acf, c0.n FROM prods p JOIN c0 ON p.series = c0.series
  JOIN kk ON kk.series = p.series WHERE p.lag <= kk.k)
"""

_KPSS = f"""cs AS (
  SELECT series, d, sum(d) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
  FROM dev),
base AS (SELECT series, sum(cs * cs) AS ss_cs, sum(d * d) AS ss FROM cs GROUP BY series),
bw AS (
  SELECT p.series, sum((1.0 - p.lag / (kk.l + 1)) * p.s) AS bw FROM prods p JOIN kk ON p.series = kk.series
  WHERE p.lag <= kk.l GROUP BY p.series),
st AS (
  SELECT kk.series, kk.n, kk.l AS lag,
         (base.ss_cs / (kk.n * kk.n)) / (base.ss / kk.n + 2.0 * coalesce(bw.bw, 0.0) / kk.n) AS stat
  FROM kk JOIN base ON kk.series = base.series LEFT JOIN bw ON kk.series = bw.series)
"""


def _kpss_p_sql(x: str) -> str:
    from tessera.operators.series.stats import KPSS_CRIT as C, KPSS_P as P
    parts = [f"WHEN {x} <= {C[0]} THEN {P[0]}"]
    for i in range(len(C) - 1):
        parts.append(f"WHEN {x} <= {C[i + 1]} THEN {P[i]} + ({x} - {C[i]}) * {(P[i + 1] - P[i]) / (C[i + 1] - C[i])}")
    return "CASE " + " ".join(parts) + f" ELSE {P[-1]} END"


ORACLES = {
    "parse_dates": _CTE + "SELECT Row_ID, order_dt, ship_dt, month FROM s2",
    "segment_month_rollup": _CTE + """SELECT market_segment, month, CAST(sales AS DOUBLE) AS sales, quantity,
  CAST(profit AS DOUBLE) AS profit FROM roll""",
    "segment_totals": _CTE + """SELECT market_segment, CAST(sum(Sales) AS DOUBLE) AS sales, CAST(sum(Quantity) AS BIGINT) AS quantity,
  CAST(sum(Profit) AS DOUBLE) AS profit FROM s2 WHERE market_segment IS NOT NULL GROUP BY market_segment""",
    "segment_stability": _CTE + """SELECT market_segment, round(mean, 4) AS mean_profit, round(sd, 4) AS sd_profit,
  CAST(total AS DOUBLE) AS total_profit, round(cv_abs, 6) AS cv_abs FROM stab""",
    "segment_score": _CTE + """SELECT market_segment, round(cv_norm, 6) AS cv_norm, round(profit_norm, 6) AS profit_norm,
  round(cv_norm * 0.5 + profit_norm * 0.5, 6) AS weighted,
  round((1 - cv_norm) * 0.5 + profit_norm * 0.5, 6) AS weighted_v1,
  CAST(row_number() OVER (ORDER BY (1 - cv_norm) * 0.5 + profit_norm * 0.5 DESC, market_segment) AS INTEGER) AS score_rank
  FROM z""",
    "top_segments": _CTE + f"""SELECT market_segment, month, CAST(sales AS DOUBLE) AS sales, quantity FROM roll
  WHERE market_segment IN (SELECT market_segment FROM z
    ORDER BY (1 - cv_norm) * 0.5 + profit_norm * 0.5 DESC, market_segment LIMIT {TOP_SEGMENTS})""",
    "standard_residuals": _CTE + """SELECT series, CAST(idx AS INTEGER) AS idx,
  round((value - smoothed - avg(value - smoothed) OVER w) / nullif(stddev_samp(value - smoothed) OVER w, 0), 6) AS std_residual
  FROM fit WINDOW w AS (PARTITION BY series)""",
    "series_index": _CTE + "SELECT series, month, CAST(idx AS INTEGER) AS idx, value FROM ser2",
    "holdout_split": _CTE + "SELECT series, CAST(idx AS INTEGER) AS idx, CAST(n_obs AS INTEGER) AS n_obs, is_test FROM ser2",
    "series_lags": _CTE + """SELECT series, CAST(idx AS INTEGER) AS idx,
  lag(value, 1) OVER w AS lag1, lag(value, 2) OVER w AS lag2,
  round(value - lag(value, 1) OVER w, 4) AS diff1
  FROM ser2 WINDOW w AS (PARTITION BY series ORDER BY idx)""",
    "ses_level": _CTE + "SELECT series, CAST(idx AS INTEGER) AS idx, round(level, 4) AS level FROM ses",
    "ses_grid": _CTE + """SELECT series, alpha, round(sqrt(avg(e * e)), 4) AS rmse, count(e) AS n_errors FROM (
  SELECT series, alpha, value - lag(level) OVER (PARTITION BY series, alpha ORDER BY idx) AS e FROM sesg)
  GROUP BY series, alpha""",
    "ses_fitted": _CTE + "SELECT series, CAST(idx AS INTEGER) AS idx, round(smoothed, 4) AS smoothed FROM fit",
    "residuals": _CTE + "SELECT series, CAST(idx AS INTEGER) AS idx, round(value - smoothed, 4) AS residual FROM fit",
    "ljung_box_lags": _CTE + f"""SELECT series, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(q, 4) AS q_stat,
  round(greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda k: exp((k + lag / 2) * ln(q / 2) - q / 2 - lgamma(k + lag / 2 + 1))))), 6) AS p_value
  FROM (SELECT series, lag, acf, n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY series ORDER BY lag) AS q
        FROM acfv WHERE lag <= {LB_LAGS})""",
    "pacf": _CTE.rstrip() + """, rl AS (SELECT series, list(acf ORDER BY lag) AS r FROM acfv GROUP BY series),
pl(series, k, phi, v, a) AS (SELECT series, 1, [r[1]], 1 - r[1] * r[1], r[1] FROM rl UNION ALL
  SELECT series, k + 1, list_append(list_transform(phi, lambda x, j: x - a2 * phi[k + 1 - j]), a2), v * (1 - a2 * a2), a2 FROM (
    SELECT p.series, p.k, p.phi, p.v,
      CASE WHEN v > 0 THEN (rl.r[k + 1] - list_sum(list_transform(phi, lambda x, j: x * rl.r[k + 1 - j]))) / v ELSE 0 END AS a2
    FROM pl p JOIN rl ON p.series = rl.series WHERE p.k < len(rl.r)))
SELECT series, CAST(k AS INTEGER) AS lag, round(a, 6) AS pacf FROM pl""",
    "acf": _CTE + "SELECT series, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM acfv",
    "kpss_test": _CTE + ", " + _KPSS + f"""SELECT series, n, CAST(lag AS INTEGER) AS lag, round(stat, 6) AS kpss_stat,
  round({_kpss_p_sql('stat')}, 6) AS p_value FROM st""",
    "ljung_box": _CTE + f"""SELECT series, CAST(max(lag) AS INTEGER) AS h,
  round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)), 4) AS q_stat
  FROM acfv WHERE lag <= least({LB_LAGS}, n - 1) GROUP BY series""",
    "forecast_accuracy": _CTE + """, lastv AS (SELECT series, arg_max(value, idx) AS forecast FROM ser2 WHERE NOT is_test GROUP BY series),
te AS (SELECT t.series, t.value AS actual, l.forecast FROM ser2 t JOIN lastv l ON t.series = l.series WHERE t.is_test)
SELECT series, round(avg(actual - forecast), 6) AS me, round(sqrt(avg((actual - forecast) * (actual - forecast))), 6) AS rmse,
  round(avg(abs(actual - forecast)), 6) AS mae, round(avg(100.0 * (actual - forecast) / actual), 6) AS mpe,
  round(avg(abs(100.0 * (actual - forecast) / actual)), 6) AS mape, count(*) AS n_test FROM te GROUP BY series""",
}


# ------------------------------------------------------------------ oracles of the regressions and recursions
def sweep_sql(rows: str, keys: list[str], terms: list[str], target: str, tolerance: float = 1e-10, exact: float = 0.0) -> str:
    """CTEs from the rows of CTE ``rows``: swept(keys, n, coef, inverse, rss, rank), one least-squares fit a key. Terms enter in
    turn; one of which less than ``tolerance`` of its own sum of squares is left is passed over."""
    cols, k, by = [*terms, target], len(terms), ", ".join(keys)
    matrix = ", ".join("[" + ", ".join(f"sum(CAST({a} AS DOUBLE) * {b})" for b in cols) + "]" for a in cols)
    return f"""gm AS MATERIALIZED (SELECT {by}, count(*) AS n, [{matrix}] AS m FROM {rows} GROUP BY {by}),
sw({by}, n, k, m, diag, used) AS (
  SELECT {by}, n, 1, m, list_transform(range(1, {k + 2}), lambda i: m[i][i]), CAST([] AS BOOLEAN[]) FROM gm UNION ALL
  SELECT {by}, n, k + 1, CASE WHEN ok THEN list_transform(m, lambda r, i: list_transform(r, lambda x, j:
    CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k]
         ELSE x - m[i][k] * m[k][j] / m[k][k] END)) ELSE m END, diag, list_append(used, ok)
  FROM (SELECT *, m[k][k] > {tolerance} * diag[k] AS ok FROM sw WHERE k <= {k})),
swept AS MATERIALIZED (SELECT {by}, n, list_transform(range(1, {k + 1}), lambda i: CASE WHEN used[i] THEN m[i][{k + 1}] ELSE 0 END) AS coef,
  list_transform(range(1, {k + 1}), lambda i: m[i][i]) AS inverse, CASE WHEN m[{k + 1}][{k + 1}] > {exact} * diag[{k + 1}] THEN m[{k + 1}][{k + 1}] ELSE 0 END AS rss,
  len(list_filter(used, lambda u: u)) AS rank FROM sw WHERE k = {k + 1})"""


_ADF_LAGS = 6        # lagged changes that the oracle writes out: enough for 343 periods


def _adf_sql() -> str:
    lagged = ", ".join(f"CASE WHEN k >= {j} THEN lag(y, {j}) OVER w ELSE 0 END AS y{j}" for j in range(1, _ADF_LAGS + 1))
    terms = ["1", "level", "trend", *[f"y{j}" for j in range(1, _ADF_LAGS + 1)]]
    crit = []
    for j in range(len(ADF_P)):
        parts = [f"WHEN nn <= {ADF_T[0]} THEN {ADF_CRIT[0][j]}"]
        for i in range(len(ADF_T) - 1):
            lo, hi = ADF_CRIT[i][j], ADF_CRIT[i + 1][j]
            parts.append(f"WHEN nn <= {ADF_T[i + 1]} THEN {lo} + (nn - {ADF_T[i]}) * ({hi} - {lo}) / ({ADF_T[i + 1]} - {ADF_T[i]})")
        crit.append("CASE " + " ".join(parts) + f" ELSE {ADF_CRIT[-1][j]} END")
    p = [f"WHEN stat <= c[1] THEN {ADF_P[0]}"]
    for j in range(len(ADF_P) - 1):
        p.append(f"WHEN stat <= c[{j + 2}] THEN {ADF_P[j]} + (stat - c[{j + 1}]) * ({ADF_P[j + 1]} - {ADF_P[j]}) / (c[{j + 2}] - c[{j + 1}])")
    return f"""{_CTE.rstrip()}, ar0 AS (SELECT series, idx, count(*) OVER s AS n, value - avg(value) OVER s AS x,
  value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS y FROM tr WINDOW s AS (PARTITION BY series)),
ar1 AS (SELECT *, CAST(trunc(pow(n - 1, 1.0 / 3)) AS INTEGER) AS k, lag(x) OVER w AS level, idx - n / 2 AS trend FROM ar0 WINDOW w AS (PARTITION BY series ORDER BY idx)),
ar2 AS (SELECT *, {lagged} FROM ar1 WINDOW w AS (PARTITION BY series ORDER BY idx)),
ar3 AS MATERIALIZED (SELECT series, n AS nobs, k AS lag_order, y, level, trend, {", ".join(terms[3:])} FROM ar2 WHERE idx >= k + 2),
{sweep_sql("ar3", ["series", "nobs", "lag_order"], terms, "y")},
st AS (SELECT series, nobs, lag_order, nobs - 1 AS nn, CASE WHEN nobs - 1 - lag_order >= lag_order + 4
  THEN coef[2] / sqrt(rss / nullif(n - rank, 0) * inverse[2]) END AS stat FROM swept),
cr AS (SELECT *, [{", ".join(crit)}] AS c FROM st)
SELECT series, nobs AS n, lag_order, {rnd_sig_sql("stat", 7)} AS adf_stat,
  round(CASE WHEN stat IS NULL THEN NULL {" ".join(p)} ELSE {ADF_P[-1]} END, 6) AS p_value FROM cr"""


_U = "((2.0 * idx - (nt + 1)) / greatest(nt - 1, 1))"
_S, _C = "sin(fa * idx)", "cos(fb * idx)"
_TREND_TERMS = ["1", _S, _C, _U, f"{_U} * {_U}", f"{_U} * {_U} * {_U}", f"{_S} * {_U}", f"{_S} * {_U} * {_U}", f"{_S} * {_U} * {_U} * {_U}",
                f"{_C} * {_U}", f"{_C} * {_U} * {_U}", f"{_C} * {_U} * {_U} * {_U}", "CAST(idx AS DOUBLE)"]
_TREND = _CTE.rstrip() + ", " + f"""pairs AS (SELECT CAST(p[1] AS DOUBLE) AS fa, CAST(p[2] AS DOUBLE) AS fb
  FROM (SELECT unnest([{", ".join(f"[{a}, {b}]" for a, b in FREQ_PAIRS)}]) AS p)),
tx AS MATERIALIZED (SELECT series, fa, fb, smoothed AS y, {", ".join(f"{t} AS t{i}" for i, t in enumerate(_TREND_TERMS))}
  FROM (SELECT series, idx, smoothed, count(*) OVER (PARTITION BY series) AS nt FROM fit), pairs),
{sweep_sql("tx", ["series", "fa", "fb"], [f"t{i}" for i in range(len(_TREND_TERMS))], "y", trend.TOLERANCE, trend.EXACT)},
pick AS (SELECT * FROM swept QUALIFY row_number() OVER (PARTITION BY series ORDER BY rss, fa, fb) = 1)
"""


def _given_sql() -> str:
    (a1, a2), b1, c = GIVEN["ar"], GIVEN["ma"][0], GIVEN["const"]
    return _CTE.rstrip() + f""", wd AS MATERIALIZED (SELECT series, idx - 1 AS t, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS w,
  count(*) OVER (PARTITION BY series) - 1 AS n FROM tr QUALIFY w IS NOT NULL),
ee(series, t, w, before, e) AS (SELECT series, t, w, 0.0::DOUBLE, 0.0::DOUBLE FROM wd WHERE t = 1 UNION ALL
  SELECT wd.series, wd.t, wd.w, ee.w, CASE WHEN wd.t <= 2 THEN 0 ELSE wd.w - {c} - {a1} * ee.w - {a2} * ee.before - {b1} * ee.e END
  FROM ee JOIN wd ON wd.series = ee.series AND wd.t = ee.t + 1),
nn AS (SELECT series, count(*) - 1 AS n, arg_max(value, idx) AS x FROM tr GROUP BY series),
var AS (SELECT nn.series, sum(e * e) / nullif(any_value(n) - 2, 0) AS v FROM nn LEFT JOIN ee ON ee.series = nn.series GROUP BY nn.series),
ff(series, k, w, before, e, x, psi, late, once, ss) AS (
  SELECT nn.series, 0, coalesce(ee.w, 0), coalesce(ee.before, 0), coalesce(ee.e, 0), nn.x, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  FROM nn LEFT JOIN ee ON ee.series = nn.series AND ee.t = nn.n UNION ALL
  SELECT series, k + 1, v, w, 0, x + v, g, psi, once + g, ss + (once + g) * (once + g) FROM (SELECT *, {c} + {a1} * w + {a2} * before + {b1} * e AS v,
    CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN {b1} + {a1} * psi ELSE {a1} * psi + {a2} * late END AS g FROM ff WHERE k < {HORIZON}))
SELECT series, CAST(idx AS INTEGER) AS idx, kind, {rnd_sig_sql("value", 8)} AS value, {rnd_sig_sql("std_error", 8)} AS std_error FROM (
  SELECT tr.series, idx, 'fitted' AS kind, value - coalesce(e, 0) AS value, NULL::DOUBLE AS std_error
  FROM tr LEFT JOIN ee ON ee.series = tr.series AND ee.t = tr.idx - 1
  UNION ALL SELECT ff.series, nn.n + 1 + k, 'forecast', ff.x, sqrt(var.v * ss) FROM ff JOIN nn ON nn.series = ff.series JOIN var ON var.series = ff.series WHERE k > 0)"""


ORACLES |= {
    "adf_test": _adf_sql(),
    "arima_given": _given_sql(),
    "trend_season_grid": _TREND + f"""SELECT f.series, f.fa, f.fb, {rnd_sig_sql("f.rss", 6)} AS rss, CAST(f.rank AS INTEGER) AS rank, f.n,
  f.fa = p.fa AND f.fb = p.fb AS chosen FROM swept f JOIN pick p ON p.series = f.series""",
    "trend_season_fit": _TREND + f"""SELECT series, fa, fb, term, {rnd_sig_sql("coef", 6)} AS coef, {rnd_sig_sql("rss", 6)} AS rss FROM (
  SELECT series, fa, fb, rss, unnest(coef) AS coef, unnest([{", ".join(f"'{t}'" for t in TERMS)}]) AS term FROM pick)""",
    "trend_season_forecast": _TREND + f"""SELECT series, idx, is_test, value, {rnd_sig_sql("trend_fit", 6)} AS trend_fit FROM (
  SELECT series, CAST(idx AS INTEGER) AS idx, is_test, value, {" + ".join(f"coef[{i + 1}] * {t}" for i, t in enumerate(_TREND_TERMS))} AS trend_fit
  FROM (SELECT s.series, s.idx, s.is_test, s.value, fa, fb, coef, n AS nt FROM ser2 s JOIN pick p ON p.series = s.series))""",
}
ORACLES["slices_round_trip"] = ORACLES["top_segments"]
