"""Regression, metrics and classification: identities and recorded numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.gram import gram
from tessera.operators.metrics import exact_interval, p_greater
from tessera.operators.regress import backward, ols, stepwise, t_two_sided_p, vif


@pytest.fixture(scope="module")
def ols_known(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 4))
    x[:, 2] = 0.6 * x[:, 0] + 0.8 * rng.normal(size=n)           # correlated pair
    y = 3.0 + 2.0 * x[:, 0] - 1.5 * x[:, 1] + 0.5 * x[:, 2] + rng.normal(scale=0.5, size=n)
    rows = [tuple(map(float, r)) + (float(v),) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "x1 double, x2 double, x3 double, x4 double, y double"), x, y


def test_gram_ols_equals_mllib_and_numpy(spark, ols_known):
    df, x, y = ols_known
    g = gram(df, ["x1", "x2", "x3", "x4", "y"])
    fit = ols(g, "y", ["x1", "x2", "x3", "x4"])
    X = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert np.allclose([fit.intercept, *fit.coef], beta, atol=1e-9)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    va = VectorAssembler(inputCols=["x1", "x2", "x3", "x4"], outputCol="f").transform(df)
    m = LinearRegression(featuresCol="f", labelCol="y", solver="normal", regParam=0.0).fit(va)
    assert np.allclose(list(m.coefficients), fit.coef, atol=1e-8)
    assert abs(m.summary.r2 - fit.r2) < 1e-9
    assert np.allclose(m.summary.pValues[:-1], fit.p_values(), atol=1e-8)


def test_vif_identity(spark, ols_known):
    df, x, _ = ols_known
    g = gram(df, ["x1", "x2", "x3", "x4", "y"])
    v = vif(g, ["x1", "x2", "x3", "x4"])
    r2 = ols(g, "x3", ["x1", "x2", "x4"]).r2
    assert abs(v["x3"] - 1.0 / (1.0 - r2)) < 1e-9


def test_stepwise_reaches_best_subset_and_backward_rule(spark, ols_known):
    import itertools

    df, _, _ = ols_known
    terms = ["x1", "x2", "x3", "x4"]
    g = gram(df, terms + ["y"])
    fit, path = stepwise(g, "y", terms)
    best = min((ols(g, "y", list(c)) for k in range(5) for c in itertools.combinations(terms, k)),
               key=lambda f: f.aic)
    assert set(fit.terms) == set(best.terms) and abs(fit.aic - best.aic) < 1e-9
    assert {"x1", "x2", "x3"} <= set(fit.terms)
    assert all(path[i + 1]["aic"] < path[i]["aic"] for i in range(len(path) - 1))
    bfit, steps = backward(g, "y", terms)
    assert all(p <= 0.05 for p in bfit.p_values())
    assert all(s["p_value"] > 0.05 for s in steps)


def test_collinear_term_dropped(spark, ols_known):
    df, _, _ = ols_known
    df2 = df.withColumn("x5", F.col("x1") * 2 + F.col("x2"))
    g = gram(df2, ["x1", "x2", "x5", "y"])
    fit = ols(g, "y", ["x1", "x2", "x5"])
    assert fit.dropped == ["x5"]


def test_t_distribution():
    assert abs(t_two_sided_p(2.0, 10) - 0.0733880) < 1e-6
    assert abs(t_two_sided_p(0.0, 5) - 1.0) < 1e-12


def test_tails_at_every_size():
    """Against sums over fine steps of the densities; the limits meet where they take over; no size takes long."""
    from tessera.operators.regress import LARGE_DF, betainc, f_upper_p

    for a, b in ((0.5, 0.5), (0.5, 3.0), (2.5, 1.0), (8.0, 11.0), (40.0, 0.5), (300.0, 250.0)):
        u = (np.arange(400_000) + 0.5) / 400_000 * (math.pi / 2)              # x = sin(u)^2
        density = np.exp((2 * a - 1) * np.log(np.sin(u)) + (2 * b - 1) * np.log(np.cos(u)))
        upto = np.cumsum(density) / density.sum()
        for x in (0.001, 0.1, 0.4, 0.5, 0.9, 0.99):
            i = np.searchsorted(u, math.asin(math.sqrt(x)))
            assert abs(betainc(a, b, x) - upto[max(i - 1, 0)]) < 5e-5
            assert abs(betainc(a, b, x) + betainc(b, a, 1 - x) - 1) < 1e-12
    for t in (0.01, 0.7, 2.0, 5.0):
        assert t_two_sided_p(t, LARGE_DF) == pytest.approx(t_two_sided_p(t, LARGE_DF + 1), rel=1e-6)
        assert f_upper_p(t, 3, LARGE_DF) == pytest.approx(f_upper_p(t, 3, LARGE_DF + 1), rel=1e-4)
        assert t_two_sided_p(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9)
    assert t_two_sided_p(60.0, 42_000) < 1e-300 or t_two_sided_p(60.0, 42_000) == 0.0


@pytest.mark.parametrize("x,lo,hi", [(9054, 0.8995, 0.9111), (9349, 0.9299, 0.9397), (1010, 0.0952, 0.1071)])
def test_exact_interval_matches_recorded(x, lo, hi):
    a, b = exact_interval(x, 10000)
    assert round(a, 4) == lo and round(b, 4) == hi


def test_accuracy_vs_nir():
    assert p_greater(9054, 10000, 0.1135) < 2.2e-16
    assert p_greater(1010, 10000, 0.1135) > 0.99


def test_classifiers_on_blobs_and_rings(spark):
    from tessera.operators.classify import RandomFourierFeatures, fit_predict, linear_svm, with_vector

    from pyspark.sql import Observation

    seen = Observation("before")                        # an observed job leaves listeners in the session
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    rng = np.random.default_rng(5)
    rows = []
    centers = np.array([[2.0, 0.0], [-2.0, 0.0], [0.0, 2.5]])
    for i in range(240):
        c = i % 3
        p = centers[c] + rng.normal(scale=0.4, size=2)
        rows.append((i, c, [float(v) for v in p]))
    df = with_vector(spark.createDataFrame(rows, "id long, digit int, features array<double>")
                     .withColumn("label", F.col("digit").cast("double")))
    pred = fit_predict(df, df, linear_svm("vec", "label", max_iter=100), ["id", "digit"])
    acc = pred.where(F.col("digit") == F.col("prediction")).count() / pred.count()
    assert acc > 0.95
    rows = []
    for i in range(300):
        c = i % 2
        r = (1.0 if c == 0 else 3.0) + rng.normal(scale=0.15)
        t = rng.uniform(0, 2 * math.pi)
        rows.append((i, c, [r * math.cos(t), r * math.sin(t)]))
    rings = with_vector(spark.createDataFrame(rows, "id long, digit int, features array<double>")
                        .withColumn("label", F.col("digit").cast("double")))
    lin = fit_predict(rings, rings, linear_svm("vec", "label", max_iter=100), ["id", "digit"])
    m = RandomFourierFeatures(inputCol="features", outputCol="rff", gamma=0.5, numFeatures=200, dim=2).transform(rings)
    rbf = fit_predict(m, m, linear_svm("rff", "label", max_iter=100), ["id", "digit"])
    a_lin = lin.where("digit = prediction").count() / 300
    a_rbf = rbf.where("digit = prediction").count() / 300
    assert a_rbf > 0.9 and a_rbf > a_lin + 0.2


def test_gram_matches_numpy(spark, ols_known):
    df, _, _ = ols_known
    cols = ["x1", "x2", "x3", "x4", "y"]
    x = df.select(*cols).toPandas().to_numpy(dtype=float)
    g = gram(df.repartition(5), cols)
    d = x - x.mean(0)
    assert g.n == len(x) and np.allclose(g.mean, x.mean(0), rtol=1e-12, atol=1e-12)
    assert np.allclose(g.cross, d.T @ d, rtol=1e-9, atol=1e-8)
    assert gram(df.limit(0), cols).n == 0


def test_folds_are_even_inside_the_training_rows(spark):
    from tessera.operators.sample import fold_of, split_flag, train_test

    df = spark.range(20_000).withColumnRenamed("id", "k")
    for folds in (3, 5):
        sizes = [r["count"] for r in df.where(split_flag("k", 0.7)).groupBy(fold_of("k", folds).alias("f")).count().collect()]
        assert len(sizes) == folds and max(sizes) <= 1.2 * min(sizes)
    null = spark.createDataFrame([(None,), (1,), (None,)], "k long")
    a, b = train_test(null, "k")
    assert a.count() + b.count() == 3


def test_metrics_of_odd_confusions(spark):
    from tessera.operators.aggregate import standard_scores
    from tessera.operators.metrics import class_metrics, confusion

    p = spark.createDataFrame([(1, 1), (1, 2)], "label int, prediction int")       # class 2 never occurs
    rows = {r["cls"]: r for r in class_metrics(confusion(p)).collect()}
    assert rows[2]["sensitivity"] is None and rows[1]["sensitivity"] == 0.5
    one = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    assert class_metrics(confusion(one)).first()["kappa"] is None
    assert standard_scores(one, {"z": "label"}).first()["z"] is None


def test_one_sum_reaches_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from tessera.operators import classify

    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    rows = spark.range(1000).selectExpr("cast(id as double) x").repartition(7)
    total = classify.tree_sum(rows, lambda b: np.array([b.num_rows, np.sum(np.asarray(b.column("x")))]), (2,))
    assert total.tolist() == [1000.0, 499500.0]
    assert [len(g) for g in got] == [1]


def test_grid_search_separates_rings(spark):
    """Classes that only a curved boundary separates: near-perfect at a fitting width, every grid point scored."""
    from tessera.operators.classify import grid_search, width_gamma
    from tessera.operators.sample import fold_of

    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        c, t = i % 3, rng.uniform(0, 2 * math.pi)
        rows.append((i, float(c), [(1 + 2 * c) * math.cos(t), (1 + 2 * c) * math.sin(t)]))
    df = spark.createDataFrame(rows, "id long, label double, features array<double>").withColumn("fold", fold_of("id", 3))
    g = width_gamma(df)
    out = grid_search(df, [g, 8 * g], [1.0, 10.0], folds=3, dim=2, n_features=100).collect()
    assert len(out) == 4 and sum(r["is_best"] for r in out) == 1
    assert max(r["mean_accuracy"] for r in out) > 0.95
    x = np.array([r[2] for r in rows])
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert math.isclose(1 / g, d2.mean(), rel_tol=1e-9)


def test_exact_sizes(spark):
    """Exactly trunc(fraction * n) rows, overall and of each class; the rows a plain sort takes."""
    from tessera.operators.sample import exact_flag, hash_int, train_test_exact

    rows = [(i * 7919 - 50_000, None if i % 11 == 0 else i % 3 if i % 2 else 0) for i in range(5_000)]
    df = spark.createDataFrame(rows, "k long, c int").repartition(7)
    h = {r["k"]: r["h"] for r in df.select("k", hash_int("k").alias("h")).collect()}
    for fraction in (0.0, 1e-5, 0.3, 0.7, 1 / 30, 0.9999, 1.0):
        got = {r["k"] for r in exact_flag(df, "k", fraction, name="t").where("t").collect()}
        assert got == set(sorted(h, key=lambda k: (h[k], k))[:int(fraction * len(rows))])
        got = {(r["k"], r["c"]) for r in exact_flag(df, "k", fraction, "c", name="t").where("t").collect()}
        want = set()
        for c in (None, 0, 1, 2):
            own = sorted((k for k, x in rows if x == c), key=lambda k: (h[k], k))
            want |= {(k, c) for k in own[:int(fraction * len(own))]}
        assert got == want
    a, b = train_test_exact(df, "k", 0.7)
    assert a.count() == 3_500 and b.count() == 1_500
    # Rows of one key stay together, null keys too; never more than asked for.
    same = spark.createDataFrame([(None,)] * 30 + [(i % 10,) for i in range(70)], "k long")
    for fraction in (0.1, 0.33, 0.5, 0.7, 1.0):
        flags = {}
        taken = 0
        for r in exact_flag(same, "k", fraction).collect():
            assert flags.setdefault(r["k"], r["is_train"]) == r["is_train"]
            taken += r["is_train"]
        assert taken <= int(fraction * 100) and (fraction < 1 or taken == 100)
    assert exact_flag(same.limit(0), "k", 0.5).count() == 0


def test_balanced_folds(spark):
    """Each class' folds differ by one row at most, whatever the partitioning, with a class of two thirds of all rows."""
    from tessera.operators.sample import balanced_folds

    df = spark.createDataFrame([(i, 0 if i % 3 else None if i % 2 else i % 7) for i in range(3_001)], "id long, c int")
    out = balanced_folds(df.repartition(9), "id", "c", 5)
    sizes = {}
    for r in out.groupBy("c", "fold").count().collect():
        sizes.setdefault(r["c"], {})[r["fold"]] = r["count"]
    for c, own in sizes.items():
        counts = [own.get(f, 0) for f in range(5)]
        assert max(counts) - min(counts) <= 1
    assert out.columns == ["id", "c", "fold"] and out.count() == 3_001
    again = balanced_folds(df.repartition(2), "id", "c", 5)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in again.collect()}


def test_qr_keeps_what_the_gram_path_loses(spark, ols_known):
    """A design of condition 1e9: coefficients and standard errors to 1e-6 of a QR of all rows, where products of columns fail."""
    from tessera.operators.qr import ols_qr, triangle

    rng = np.random.default_rng(17)
    n = 3000
    u, _ = np.linalg.qr(rng.normal(size=(n, 5)))
    v, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = 1e3 * u @ np.diag(np.logspace(0, -9, 5)) @ v.T
    y = x @ [1.0, -2.0, 3.0, 0.5, 1.5] + 4.0 + 1e-7 * rng.normal(size=n)
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(*map(float, r), float(w)) for r, w in zip(x, y)] + [(None, *[1.0] * 5)], ", ".join(f"{c} double" for c in [*names, "y"])).repartition(70)
    full = np.column_stack([np.ones(n), x])
    q, r = np.linalg.qr(full)
    want = np.linalg.solve(r, q.T @ y)
    e = y - full @ want
    se = np.sqrt(float(e @ e) / (n - 6) * (np.linalg.inv(r) ** 2).sum(axis=1))
    spark.conf.set("spark.sql.shuffle.partitions", "1100")           # two levels of the tree
    try:
        fit = ols_qr(df, "y", names, tol=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert fit.n == n and np.allclose([fit.intercept, *fit.coef], want, rtol=1e-6, atol=1e-6)
    assert np.allclose([fit.intercept_se, *fit.se], se, rtol=1e-5)
    g = ols(gram(df, [*names, "y"]), "y", names, tol=0.0)
    assert len(g.coef) < 5 or not np.allclose(g.coef, want[1:], rtol=1e-3)
    known, _, _ = ols_known
    same = known.withColumn("x5", F.col("x1") * 2 + F.col("x2"))
    a, b = ols_qr(same, "y", ["x1", "x2", "x5", "x3"]), ols(gram(same, ["x1", "x2", "x3", "y"]), "y", ["x1", "x2", "x3"])
    assert a.dropped == ["x5"] and a.terms == ["x1", "x2", "x3"]
    assert np.allclose([a.intercept, *a.coef, *a.se, a.intercept_se, a.rss, a.tss], [b.intercept, *b.coef, *b.se, b.intercept_se, b.rss, b.tss])
    assert triangle(known.limit(0), ["x1"])[1] == 0 and ols_qr(known.limit(0), "y", ["x1"]).terms == []


def test_pairwise_svm_matches_plain(spark):
    """Each pair's weights reach the optimum of its own rows; votes as counted by hand; ties by margins."""
    from tessera.operators.classify import PairwiseSvm, one_against_one

    rng = np.random.default_rng(8)
    y = rng.integers(0, 4, 400) * 2 + 1
    x = rng.normal(size=(400, 3)) + np.column_stack([y % 3, y // 3, 0 * y])
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for c, r in zip(y, x)] + [(None, [0.0] * 3), (1, None)], "digit int, features array<double>")
    model = one_against_one(df.repartition(3), c=2.0)
    assert model.classes.tolist() == [1, 3, 5, 7] and len(model.pairs) == 6
    z = np.column_stack([x, np.ones(400)])
    for (i, j), w in zip(model.pairs, model.weights):
        own = np.isin(y, model.classes[[i, j]])
        s, zz = np.where(y[own] == model.classes[i], 1.0, -1.0), z[own]
        best = np.zeros(4)
        for _ in range(60):                                              # Newton steps on the active rows
            on = s * (zz @ best) < 1
            h = 2 * zz[on].T @ zz[on] / own.sum() + np.eye(4) / (2.0 * own.sum())
            best = np.linalg.solve(h, 2 * zz[on].T @ s[on] / own.sum())
        assert np.allclose(w, best, atol=2e-3)
    got = [r["p"] for r in df.where("digit IS NOT NULL AND features IS NOT NULL").select(model.column("features").alias("p")).collect()]
    m = z @ model.weights.T
    for row, p in zip(m, got):
        votes, total = dict.fromkeys(range(4), 0), dict.fromkeys(range(4), 0.0)
        for (i, j), v in zip(model.pairs, row):
            votes[i if v > 0 else j] += 1
            total[i] += v
            total[j] -= v
        assert p == model.classes[max(range(4), key=lambda k: (votes[k], total[k], -k))]
    ring = PairwiseSvm(np.array([0, 1, 2]), np.array([[1.0, 0.0], [-3.0, 0.0], [2.0, 0.0]]))     # 0 beats 1, 2 beats 0, 1 beats 2
    assert ring.label(np.array([[1.0]])).tolist() == [1]                 # sums of margins: -2, 1, 1; the lower class
    one = one_against_one(df.where("digit = 3"))
    assert {r["p"] for r in df.where("features IS NOT NULL").select(one.column("features").alias("p")).collect()} == {3}
    assert df.select(model.column("features").alias("p")).where("p IS NULL").count() == 1


def test_smooth_matches_a_plain_penalised_spline(spark):
    """Coefficients from a cell's sums equal those of all rows; the weight is the plain search's; a sine comes back."""
    from tessera.operators import spline

    rng = np.random.default_rng(4)
    x = rng.uniform(-3, 7, 2000)
    y = 50 + 10 * np.sin(x) + rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)], "x double, y double").repartition(5)
    s = spline.fit(df, "x", "y")
    lo, hi, m = x.min(), x.max(), spline.CELLS + 3
    u = (x - lo) / (hi - lo) * spline.CELLS
    # the basis by its recursion on the knots
    knots = np.arange(-3, spline.CELLS + 4)
    b = ((u[:, None] >= knots[:-1]) & (u[:, None] < knots[1:])).astype(float)
    b[u >= spline.CELLS] = np.arange(b.shape[1]) == spline.CELLS + 2          # the last point ends the last cell
    for d in range(1, 4):
        k = b.shape[1] - 1
        b = (u[:, None] - knots[:k]) / d * b[:, :k] + (knots[d + 1:d + 1 + k] - u[:, None]) / d * b[:, 1:k + 1]
    b = b[:, :m]
    g, v, pen = b.T @ b, b.T @ (y - y.mean()), spline.penalty(m)
    found = []
    for w in spline.WEIGHTS:
        a = g + w * np.trace(g) / np.trace(pen) * pen
        beta, hat = np.linalg.solve(a, v), np.trace(np.linalg.solve(a, g))
        rss = float(np.sum((y - y.mean() - b @ beta) ** 2))
        found.append((2000 * rss / (2000 - hat) ** 2, w, beta, rss / (2000 - hat) * np.linalg.inv(a)))
    _, w, beta, cov = min(found, key=lambda r: r[0])
    assert s.weight == w and np.allclose(s.beta, beta, rtol=1e-6, atol=1e-6) and np.allclose(s.cov, cov, rtol=1e-5, atol=1e-9)
    rows = spline.smooth_trend(df, "x", "y").collect()
    assert len(rows) == 21 and all(abs(r["fit"] - 50 - 10 * math.sin(r["x"])) < 5 * r["std_error"] + 0.3 for r in rows)
    assert spline.smooth_trend(df.where("x > 100"), "x", "y").count() == 0
    assert spline.smooth_trend(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y").count() == 0
