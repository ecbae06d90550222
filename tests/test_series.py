"""Time-series operators: recorded numbers, identities, simulated series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.aggregate import segment_scores
from tessera.operators.series import acf, adf, kpss, ljung_box, pacf, ses_fitted, ses_levels
from plain_series import (
    adf_one, adf_p_value, chi2_sf, css_fit, css_innovations, forecast, hr_candidates, information_criteria, kpss_one, n_diffs, pacf_one,
)
from tessera.operators.matrix import gram_sums, solve
from tessera.operators.series import arima as A
from tessera.operators.series import stats
from tessera.operators.series.trend import choose, evaluate, fit_grid


def _frame(spark, series: dict):
    rows = [(k, i + 1, float(v)) for k, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "series string, idx int, value double")


@pytest.fixture(scope="module")
def sim():
    rng = np.random.default_rng(42)
    n = 500
    e = rng.normal(size=n + 2)
    ar2 = np.zeros(n)
    for t in range(2, n):
        ar2[t] = 0.5 * ar2[t - 1] - 0.3 * ar2[t - 2] + e[t]
    ma1 = e[1:n + 1] + 0.6 * e[:n]
    rw = np.cumsum(rng.normal(size=n))
    wn = rng.normal(size=n)
    m = np.arange(1, 49)
    trend = 100 + 2 * m + 10 * np.sin(0.5 * m) + rng.normal(scale=0.5, size=48)
    return {"ar2": ar2, "ma1": ma1, "rw": rw, "wn": wn, "trend": trend}


def value_of(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def criteria_of(spark, loglik, k, n):
    c = A.criteria(F.lit(float(loglik)), F.lit(k), F.lit(n))
    return tuple(spark.range(1).select(*[c[x].alias(x) for x in ("aic", "aicc", "bic")]).first())


def test_recorded_information_criteria(spark):
    aic, aicc, bic = criteria_of(spark, -445.84, 3, 41)
    assert (round(aic, 2), round(aicc, 2), round(bic, 2)) == (897.68, 898.33, 902.82)
    assert (aic, aicc, bic) == pytest.approx(information_criteria(-445.84, 3, 41))


def test_recorded_test_lags_and_adf_p(spark):
    assert value_of(spark, stats.kpss_lag(F.lit(42))) == 1         # KPSS lag printed as 1
    assert value_of(spark, stats.adf_lag(F.lit(42))) == 3          # ADF lag printed as 3
    for stat, n in ((-3.5473, 41), (-4.4433, 41), (-9.0, 41), (0.5, 41), (-2.2, 12), (-2.2, 300), (-1.0, 10**6)):
        assert value_of(spark, stats.adf_p_value(F.lit(stat), F.lit(n))) == pytest.approx(adf_p_value(stat, n), abs=1e-12)
    assert round(adf_p_value(-3.5473, 41), 5) == 0.04911
    assert adf_p_value(-4.4433, 41) == 0.01


def test_chi_square_tail(spark):
    grid = [(q, df) for q in (0.0, 1e-6, 0.3, 1.0, 3.9, 4.0, 4.1, 9.0, 25.0, 60.0, 200.0) for df in (1, 2, 3, 4, 5, 10, 11, 30)]
    rows = spark.createDataFrame(grid, "q double, df int").withColumn("p", stats.chi2_sf(F.col("q"), F.col("df"))).collect()
    for r in rows:
        assert r["p"] == pytest.approx(chi2_sf(r["q"], r["df"]), abs=1e-12)
    assert value_of(spark, stats.chi2_sf(F.lit(3.0), F.lit(0))) is None


def test_sweep_solves_and_passes_over(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1.0, 1e3, 1.0, 1e-3]
    x[:, 2] = x[:, 0] * 2 + x[:, 1]
    y = x @ [1.0, 2.0, 0.0, 3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v), 0.0) for r, v in zip(x, y)], "a double, b double, c double, d double, y double, z double")
    g = df.agg(gram_sums([F.lit(1.0), *[F.col(c) for c in "azbcdy"]]).alias("g"))
    s = g.select(solve(F.col("g"), F.sequence(F.lit(0), F.lit(5))).alias("s")).first()["s"]
    m = np.column_stack([np.ones(200), x[:, [0, 1, 3]]])
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert s["rank"] == 4 and s["coef"][2] is None and s["coef"][4] is None          # all zero; explained by two others
    assert np.allclose([s["coef"][i] for i in (0, 1, 3, 5)], beta, rtol=1e-6) and s["rss"] == pytest.approx(rss[0])
    assert np.allclose([s["inverse"][i] for i in (0, 1, 3, 5)], np.diag(np.linalg.inv(m.T @ m)), rtol=1e-6)
    few = g.select(solve(F.col("g"), F.array(F.lit(3))).alias("s")).first()["s"]
    assert few["rank"] == 1 and few["coef"][3] == pytest.approx(float(x[:, 1] @ y / (x[:, 1] @ x[:, 1])))


def test_recorded_segment_scores(spark):
    # the two standardised inputs of the top row are printed; check the weighted forms
    cv, pr = -0.589725879, 2.427869482
    assert round(cv * 0.5 + pr * 0.5, 6) == 0.919072
    assert round((1 - cv) * 0.5 + pr * 0.5, 6) == 2.008798
    df = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 30.0), ("c", 4.0, 20.0)], "k string, cv_abs double, total double")
    z = {r["k"]: r for r in segment_scores(df).collect()}
    x = np.array([1.0, 2.0, 4.0])
    assert abs(z["a"]["cv_norm"] - (1 - x.mean()) / x.std(ddof=1)) < 1e-12


def test_ses_equals_closed_form(spark, sim):
    x = sim["trend"]
    df = _frame(spark, {"s": x})
    for a in (0.2, 0.5, 0.7):
        got = [r["level"] for r in ses_levels(df, alpha=a).orderBy("idx").collect()]
        want = [sum(a * (1 - a) ** (t - k) * x[k] for k in range(1, t + 1)) + (1 - a) ** t * x[0]
                for t in range(len(x))]
        assert np.allclose(got, want, rtol=1e-12)
    fitted = [r["smoothed"] for r in ses_fitted(ses_levels(df, alpha=0.5)).orderBy("idx").collect()]
    assert fitted[-1] == fitted[-2]


def test_acf_pacf_ljung_box(spark, sim):
    x = sim["ar2"][:200]
    df = _frame(spark, {"s": x})
    got = {r["lag"]: r["acf"] for r in acf(df).collect()}
    d = x - x.mean()
    for k in (1, 2, 5):
        assert abs(got[k] - (d[:-k] @ d[k:]) / (d @ d)) < 1e-10
    assert len(got) == int(10 * math.log10(200))
    r = np.array([got[k] for k in sorted(got)])
    p = {r_["lag"]: r_["pacf"] for r_ in pacf(df).collect()}
    assert np.allclose([p[k] for k in sorted(p)], pacf_one(r), atol=1e-10)
    assert p[2] < -0.15                                   # AR(2) with phi2 = -0.3
    q = ljung_box(acf(df), h=10).first()["q_stat"]
    want = 200 * 202 * sum(r[k - 1] ** 2 / (200 - k) for k in range(1, 11))
    assert abs(q - want) < 1e-8 and chi2_sf(q, 10) < 0.01


def test_kpss_and_adf_decide(spark, sim):
    df = _frame(spark, {"wn": sim["wn"], "rw": sim["rw"]})
    k = {r["series"]: r for r in kpss(df).collect()}
    for s in ("wn", "rw"):
        stat, _ = kpss_one(sim[s])
        assert abs(k[s]["kpss_stat"] - stat) < 1e-9
    assert k["wn"]["p_value"] == 0.1 and k["rw"]["p_value"] == 0.01
    a = {r["series"]: r for r in adf(df).collect()}
    assert a["wn"]["p_value"] == 0.01 and a["rw"]["p_value"] > 0.1
    assert a["wn"]["lag_order"] == int(math.trunc(499 ** (1 / 3)))
    for s in ("wn", "rw"):
        assert a[s]["adf_stat"] == pytest.approx(adf_one(sim[s])[0], rel=1e-8)


def test_adf_of_many_lengths(spark):
    rng = np.random.default_rng(3)
    many = {f"s{n}": 1e5 + 50 * np.cumsum(rng.normal(size=n)) for n in (1, 2, 5, 8, 9, 10, 20, 41, 65, 66, 130)} | {"flat": np.full(30, 7.0), "line": np.arange(30.0)}
    got = {r["series"]: r for r in adf(_frame(spark, many)).collect()}
    assert set(got) == set(many)
    for s, x in many.items():
        if s in ("flat", "line"):
            assert got[s]["adf_stat"] is None and got[s]["p_value"] is None
            continue
        stat, k, p = adf_one(x)
        assert got[s]["lag_order"] == k and got[s]["n"] == len(x)
        assert got[s]["adf_stat"] == (None if stat is None else pytest.approx(stat, rel=1e-6))
        assert got[s]["p_value"] == (None if stat is None else pytest.approx(p, rel=1e-6))
    fixed = {r["series"]: r for r in adf(_frame(spark, many), k=2).collect()}
    assert fixed["s41"]["adf_stat"] == pytest.approx(adf_one(many["s41"], 2)[0], rel=1e-6)


@pytest.fixture(scope="module")
def arima_series(sim):
    rng = np.random.default_rng(9)
    e = rng.normal(size=404)
    ar4 = np.zeros(400)
    for t in range(4, 400):
        ar4[t] = 0.2 * ar4[t - 1] - 0.6 * ar4[t - 4] + e[t]
    short = 50 + 5 * np.sin(np.arange(41)) + rng.normal(size=41)
    return {"rw": sim["rw"][:200], "drift": np.cumsum(rng.normal(loc=0.8, size=300)), "ar2": sim["ar2"], "ma1": sim["ma1"][:300] + 3.0,
            "ar4": ar4, "short": short, "twice": np.cumsum(np.cumsum(rng.normal(size=150))),
            "tiny": np.array([1.0, 2.0, 4.0, 3.0]), "one": np.array([1.0]), "flat": np.full(40, 5.0), "line": np.arange(40.0)}


@pytest.fixture(scope="module")
def arima_fitted(spark, arima_series):
    models, path = A.arima(_frame(spark, arima_series), h=8)
    rows = {}
    for r in path.orderBy("series", "idx").collect():
        rows.setdefault(r["series"], {"fitted": [], "forecast": []})[r["kind"]].append(r)
    return {r["series"]: r for r in models.collect()}, rows


def test_arima_candidates_match_plain(spark, arima_series):
    """The order of differencing and every candidate's AICc equal a plain version's."""
    w = A.differenced(_frame(spark, arima_series), "series", "idx", "value")
    rows = A.candidates(A.regressions(w)).collect()
    assert {r["series"]: r["d"] for r in w.collect()} == {s: n_diffs(x) for s, x in arima_series.items()}
    for s in ("rw", "drift", "ar2", "ma1", "ar4", "short", "twice"):
        x, d = arima_series[s], n_diffs(arima_series[s])
        want = hr_candidates(np.diff(x, n=d) if d else x, d)
        got = {(r["c"], r["p"], r["q"]): r for r in rows if r["series"] == s}
        assert set(got) == set(want)
        for k, (rss, aicc) in want.items():
            assert got[k]["rss"] == pytest.approx(rss, rel=1e-6)
            assert got[k]["aicc"] == (None if aicc is None else pytest.approx(aicc, rel=1e-6))


def test_arima_orders(arima_fitted):
    m, path = arima_fitted
    assert m["rw"]["d"] == 1 and m["drift"]["d"] == 1 and m["twice"]["d"] == 2
    assert abs(m["drift"]["const"] - 0.8) < 0.2
    assert m["ar2"]["d"] == 0 and m["ar2"]["p"] >= 2 and m["ar4"]["p"] >= 4
    assert all(0.01 < v < 0.2 for v in m["ar2"]["ar_se"][:2])
    assert m["ma1"]["d"] == 0 and (m["ma1"]["q"] >= 1 or m["ma1"]["p"] >= 2)
    assert [m[s]["status"] for s in ("ar2", "tiny", "one", "flat", "line")] == ["ok", "short", "short", "exact", "exact"]
    assert [r["value"] for r in path["flat"]["forecast"]] == [5.0] * 8
    assert np.allclose([r["value"] for r in path["line"]["forecast"]], np.arange(40, 48))
    assert np.allclose([r["value"] for r in path["tiny"]["forecast"]], 2.5)


def test_arima_estimates_match_plain(arima_series, arima_fitted):
    """T11 + T12: estimates, likelihood, criteria, standard errors, fitted values and forecasts equal a plain fit's."""
    m, path = arima_fitted
    for s in ("rw", "drift", "ar2", "ma1", "ar4", "short", "twice"):
        r, x = m[s], arima_series[s]
        d, p, q = r["d"], r["p"], r["q"]
        w = np.diff(x, n=d) if d else x
        c = int(r["const_se"] is not None)
        own = np.array([*[r["const"]] * c, *r["ar"], *r["ma"]])
        b, rss, se = css_fit(w, c, p, q, own + 1e-3)
        n = len(w) - p
        assert np.allclose(own, b, rtol=1e-5, atol=1e-6) and r["n_used"] == n
        assert r["sigma2"] == pytest.approx(rss / n, rel=1e-6)
        ll = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1)
        assert (r["loglik"], r["aic"], r["aicc"], r["bic"]) == pytest.approx((ll, *information_criteria(ll, c + p + q + 1, n)), rel=1e-6)
        assert np.allclose([*[r["const_se"]] * c, *r["ar_se"], *r["ma_se"]], se, rtol=1e-4)
        e = css_innovations(w, c, p, q, own)
        assert np.allclose([v["value"] for v in path[s]["fitted"]], x - np.concatenate([np.zeros(d), e]), atol=1e-8)
        fc, err = forecast(x, d, c, p, q, own, r["sigma2"], 8)
        assert np.allclose([v["value"] for v in path[s]["forecast"]], fc, rtol=1e-8)
        assert np.allclose([v["std_error"] for v in path[s]["forecast"]], err, rtol=1e-8)


def test_given_coefficients(spark, arima_series):
    x = {k: arima_series[k] for k in ("short", "tiny", "one", "twice")}
    for d, const, ar, ma in ((0, 1.5, [0.5, -0.2], [0.3]), (1, 0.0, [], [0.4, 0.1]), (2, 0.1, [0.3], [])):
        rows = A.apply_model(_frame(spark, x), d, const, ar, ma, h=5).where("kind = 'forecast'").orderBy("idx").collect()
        for s in ("short", "twice"):
            b = np.array([const, *ar, *ma])
            e = css_innovations(np.diff(x[s], n=d) if d else x[s], 1, len(ar), len(ma), b)
            fc, err = forecast(x[s], d, 1, len(ar), len(ma), b, float(e @ e) / (len(e) - len(ar)), 5)
            own = [r for r in rows if r["series"] == s]
            assert np.allclose([r["value"] for r in own], fc) and np.allclose([r["std_error"] for r in own], err)
        assert {r["series"] for r in rows} == set(x)


def test_trend_season_fit_recovers_and_drops_collinear(spark, sim):
    x = sim["trend"][:42]
    df = _frame(spark, {"s": x})
    fits = fit_grid(df)
    assert {r["rank"] for r in fits.collect()} == {12}          # M collinear with the linear term
    ch = choose(fits).first()
    assert (ch["fa"], ch["fb"]) in {(0.5, 0.5), (0.5, 0.6), (0.5, 0.3)}   # sin(0.5 M) was simulated
    ev = evaluate(_frame(spark, {"s": sim["trend"]}), choose(fits)).orderBy("idx").collect()
    fitted = np.array([r["trend_fit"] for r in ev])
    m = np.arange(1, 43)
    u = (2 * m - 43) / 41
    X = np.column_stack([np.ones(42), np.sin(ch["fa"] * m), np.cos(ch["fb"] * m), u, u ** 2, u ** 3,
                         np.sin(ch["fa"] * m) * u, np.sin(ch["fa"] * m) * u ** 2, np.sin(ch["fa"] * m) * u ** 3,
                         np.cos(ch["fb"] * m) * u, np.cos(ch["fb"] * m) * u ** 2, np.cos(ch["fb"] * m) * u ** 3])
    beta, *_ = np.linalg.lstsq(X, x, rcond=None)
    assert np.allclose(fitted[:42], X @ beta, atol=1e-6)


def test_gap_and_short_series(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 4, 8.0), ("b", 1, 3.0)],
                               "series string, idx int, value double")
    lv = {(r["series"], r["idx"]): r["level"] for r in ses_levels(df, alpha=0.5).collect()}
    assert lv[("b", 1)] == 3.0 and lv[("a", 4)] == 0.5 * 8 + 0.5 * (0.5 * 6 + 0.5 * 5)
    assert acf(df.where("series = 'b'")).count() == 0


def test_degenerate_series_have_null_results(spark):
    """A constant series and an actual of 0 end no job (ANSI mode is on)."""
    from tessera.operators.series import kpss
    from tessera.operators.series.accuracy import accuracy

    flat = spark.createDataFrame([("c", i, 5.0) for i in range(1, 30)], "series string, idx int, value double")
    assert {r["acf"] for r in acf(flat).collect()} == {None}
    assert kpss(flat).first()["kpss_stat"] is None
    f = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0)], "series string, actual double, forecast double")
    assert accuracy(f, ["series"]).first()["mape"] == 50.0


def test_series_gaps_close_up_or_fill(spark):
    from tessera.plans.forecast import series_table

    roll = spark.createDataFrame([("EU-Consumer", "2014-01", 1.0, 2), ("EU-Consumer", "2014-03", 3.0, 4),
                                  ("APAC-Consumer", "2014-02", 5.0, 6)],
                                 "market_segment string, month string, sales double, quantity long")
    closed = {(r["series"], r["month"]): r["idx"] for r in series_table(roll).collect()}
    assert closed[("EU-Consumer:sales", "2014-03")] == 2                      # gap closes up (N15)
    filled = {(r["series"], r["month"]): (r["idx"], r["value"]) for r in series_table(roll, fill_gaps=True).collect()}
    assert filled[("EU-Consumer:sales", "2014-02")] == (2, 0.0) and filled[("EU-Consumer:sales", "2014-03")][0] == 3
    assert filled[("APAC-Consumer:quantity", "2014-02")] == (1, 6.0)          # one-period series


# The eight printed model summaries (log-likelihood; AIC, AICc, BIC),
# with k = estimated parameters incl. sigma^2 and n = values after differencing.
PRINTED_MODELS = [
    (-449.04, 1, 42, 900.08, 900.18, 901.82),   # (0,0,0) zero mean on the trend residual
    (-445.84, 3, 41, 897.67, 898.32, 902.81),   # (2,1,0)
    (-264.39, 1, 42, 530.79, 530.89, 532.53),   # (0,0,0) zero mean
    (-261.9, 3, 41, 529.8, 530.44, 534.94),     # (2,1,0)
    (-446.23, 1, 42, 894.45, 894.55, 896.19),   # (0,0,0) zero mean
    (-447.11, 2, 41, 898.23, 898.55, 901.66),   # (0,1,1)
    (-257.87, 1, 42, 517.74, 517.84, 519.48),   # (0,0,0) zero mean
    (-266.07, 1, 41, 534.14, 534.24, 535.85),   # (0,1,0)
]


@pytest.mark.parametrize("ll,k,n,aic,aicc,bic", PRINTED_MODELS)
def test_printed_information_criteria(spark, ll, k, n, aic, aicc, bic):
    a, ac, b = criteria_of(spark, ll, k, n)
    assert abs(a - aic) <= 0.02 and abs(ac - aicc) <= 0.02 and abs(b - bic) <= 0.02


# The five printed segment rows (standardised CV, standardised profit,
# weighted, weighted_v1).
PRINTED_SCORES = [
    (-0.589725879, 2.427869482, 0.919071801, 2.00879768),
    (-0.496955338, 1.886065087, 0.694554874, 1.691510212),
    (-0.585263338, 0.950238458, 0.18248756, 1.267750898),
    (-0.486361213, 0.849540584, 0.181589686, 1.167950899),
    (-0.36620092, 0.805709523, 0.219754302, 1.085955221),
]


@pytest.mark.parametrize("cv,pr,w,w1", PRINTED_SCORES)
def test_printed_segment_scores(spark, cv, pr, w, w1):
    from tessera.operators.aggregate import weighted_scores

    r = weighted_scores(spark.createDataFrame([(cv, pr)], "cv_norm double, profit_norm double")).first()
    assert abs(r["weighted"] - w) < 1e-8 and abs(r["weighted_v1"] - w1) < 1e-8


def test_residual_tests_cover_both_models(spark):
    from tessera.plans import forecast

    SF_SMALL = "/root/testdata/sf0.001"
    rows = forecast.q_residual_tests(spark, SF_SMALL).collect()
    got = {(r["series"], r["model"]): r for r in rows}
    c = forecast._Ctx(spark, SF_SMALL)
    fitted = {(r["series"], r["idx"]): r["value"] for r in c.arima_raw()[1].where("kind = 'fitted'").collect()}
    res = spark.createDataFrame([(r["series"], r["idx"], r["value"] - fitted[r["series"], r["idx"]]) for r in c.train().collect()],
                                "series string, idx int, value double")
    names = {s for s, _ in got}
    assert len(rows) == len(got) and set(got) == {(s, m) for s in names for m in ("trend_arma", "arima")}
    for r in adf(res).collect():
        assert got[r["series"], "arima"]["adf_stat"] == (None if r["adf_stat"] is None else pytest.approx(r["adf_stat"]))
    for r in kpss(res).collect():
        assert got[r["series"], "arima"]["kpss_stat"] == pytest.approx(r["kpss_stat"], nan_ok=True)
