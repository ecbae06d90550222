"""ARIMA order choice, fit and forecast for many series (T10-T12), all as Spark expressions.

1. Differencing (at most twice) while the KPSS level test rejects at 5 %: one job for all series and orders.
2. Order choice after Hannan and Rissanen: a long autoregression, solved from one Gram row a series, gives
   innovation estimates; a second Gram row of a constant, ``MAX_P`` lags and ``MAX_Q`` lagged innovations holds
   every candidate (p, q), with and without a constant, as a block. All are swept out of that row, on the same
   sample, so their AICc compare.
3. Estimation by conditional sum of squares: the innovations, their derivatives and the products of both are
   one fold over a series' array; damped Gauss-Newton steps are a fold over that.
4. Forecasts by recursion, undifferenced by cumulative sums, with standard errors from the psi weights.

A series is one row with an array of its periods, which the calendar bounds; more data means more rows. A model's
parameters are an array: the constant, if any, then p autoregressive and q moving-average coefficients.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matrix import add_outer, at, dot, gram_sums, last, let, none, sizes, solve, sweep, unit, upto
from tessera.operators.series.stats import kpss
from tessera.session import materialize

MAX_P = MAX_Q = 5
MAX_D = 2
ALPHA = 0.05
LONG = MAX_P + 2             # lags of the long autoregression, at most a quarter of the series
EXACT = 1e-12                # share of the sum of squares that counts as nothing left to explain
STEPS = 60                   # damped Gauss-Newton steps, at most

MODEL_COLS = ["p", "d", "q", "const", "ar", "ma", "const_se", "ar_se", "ma_se", "sigma2", "loglik", "aic", "aicc", "bic",
              "n_used", "status"]


def criteria(loglik: Column, k: Column, n: Column) -> dict[str, Column]:
    """AIC, AICc and BIC for k estimated parameters (sigma^2 included) and n values; no AICc where n <= k + 1."""
    aic = -2.0 * loglik + 2.0 * k
    return {"aic": aic, "aicc": F.when(n - k - 1 > 0, aic + 2.0 * k * (k + 1.0) / F.nullif(n - k - 1, F.lit(0))),
            "bic": -2.0 * loglik + k * F.log(n.cast("double"))}


def gaussian(rss: Column, n: Column) -> Column:
    """Log-likelihood at the residual variance rss / n; null where nothing is left to explain."""
    return -0.5 * n * (F.log(2.0 * math.pi * rss / F.nullif(n, F.lit(0))) + 1.0)


# ---- differencing order

def differenced(df: DataFrame, series: str, idx: str, value: str) -> DataFrame:
    """(series, idx, x, d, n, t, w): each series differenced as often as its KPSS tests ask for; w is null for
    the first d periods, t counts from 1 where it isn't."""
    own, x = Window.partitionBy("series").orderBy("idx"), F.col("x")
    rows = df.select(F.col(series).alias("series"), F.col(idx).cast("int").alias("idx"), F.col(value).cast("double").alias("x"))
    rows = materialize(rows.withColumn("place", F.row_number().over(own))
                       .withColumn("w", F.array(x, x - F.lag(x).over(own), x - 2 * F.lag(x).over(own) + F.lag(x, 2).over(own))))
    long = rows.select("series", "place", F.posexplode("w").alias("d", "w")).where("w IS NOT NULL") \
        .withColumn("key", F.concat_ws(":", "d", "series"))
    tests = kpss(long, "key", "place", "w")
    rejects = tests.select(F.expr("substring(key, 3)").alias("series"), F.substring("key", 1, 1).cast("int").alias("d"),
                           ((F.col("n") > 4) & F.col("kpss_stat").isNotNull() & (F.col("p_value") < ALPHA)).alias("no")) \
        .groupBy("series").agg(*[F.max(F.when(F.col("d") == d, F.col("no"))).alias(f"no{d}") for d in range(MAX_D)])
    order = rejects.select("series", F.when(~F.col("no0"), 0).when(~F.coalesce("no1", F.lit(False)), 1).otherwise(2).alias("d"))
    return rows.join(order, "series").select("series", "idx", "x", "d", (F.count("*").over(Window.partitionBy("series")) - F.col("d")).cast("int").alias("n"),
                                             (F.col("place") - F.col("d")).alias("t"), F.get("w", F.col("d")).alias("w"))


# ---- order choice

def pivots(c: Column, p: Column, q: Column) -> Column:
    """Places of a model's terms among constant, lags and innovations."""
    return F.concat(upto(c), upto(p, 1), upto(q, 1 + MAX_P))


def regressions(w: DataFrame) -> DataFrame:
    """(series, d, n, rows, g): the products of a constant, lags, lagged innovations and the value over the common
    sample, one matrix a series. The innovations are those of the long autoregression."""
    own = Window.partitionBy("series").orderBy("t")
    rows = w.where("t >= 1").select("series", "d", "n", "t", "w", F.least(F.lit(LONG), F.greatest(F.lit(1), F.col("n") / 4).cast("int")).alias("m"))
    lagged = [F.when(F.col("m") >= i, F.lag("w", i).over(own)).otherwise(0.0).alias(f"l{i}") for i in range(1, LONG + 1)]
    rows = rows.select("*", *lagged)
    lags = [F.col(f"l{i}") for i in range(1, LONG + 1)]
    first = rows.where(F.col("t") > F.col("m")).groupBy("series").agg(gram_sums([F.lit(1.0), *lags, F.col("w")]).alias("g"))
    long_ar = first.select("series", F.transform(solve(F.col("g"), F.sequence(F.lit(0), F.lit(LONG)))["coef"], lambda x: F.coalesce(x, F.lit(0.0))).alias("b"))
    known = (F.col("n") - F.col("m") > F.col("m") + 2) & (F.col("t") > F.col("m"))
    rows = rows.join(long_ar, "series").select("series", "d", "n", "t", "m", "w", F.when(
        known, F.col("w") - dot(F.col("b"), F.array(F.lit(1.0), *lags))).otherwise(0.0).alias("e"))
    terms = [F.lag(v, i).over(own).alias(f"{v}{i}") for v, top in (("w", MAX_P), ("e", MAX_Q)) for i in range(1, top + 1)]
    names = [F.col(f"{v}{i}") for v, top in (("w", MAX_P), ("e", MAX_Q)) for i in range(1, top + 1)]
    return rows.select("*", *terms).where(F.col("t") > F.col("m") + MAX_Q).groupBy("series", "d", "n").agg(
        F.count("*").alias("rows"), gram_sums([F.lit(1.0), *names, F.col("w")]).alias("g"))


def candidates(rows: DataFrame) -> DataFrame:
    """Every candidate of every series of ``regressions`` that is long enough: (series, d, n, c, p, q, rows, rss,
    aic, aicc, bic). ``c`` is 1 with a constant: a mean where d = 0, a drift where d = 1, none where d = 2.

    For each c and q the matrix is swept on the constant and the innovations, then on one lag after another."""
    bases = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(q).alias("q")) for c in (0, 1) for q in range(MAX_Q + 1)])
    # Few series make a small table: dealt out by series all the same, for the solving is the work.
    each = rows.where(F.col("rows") > MAX_P + MAX_Q + 4).repartition(_parts(rows), "series") \
        .select("series", "d", "n", "rows", "g", F.inline(bases)).where("c = 0 OR d < 2")

    def left(size: Column) -> Column:
        begin = F.struct(sweep(unit(F.col("g"), size), F.concat(upto(F.col("c")), upto(F.col("q"), 1 + MAX_P))).alias("a"), none().alias("rss"))

        def step(s: Column, p: Column) -> Column:
            return let(F.when(p > 0, sweep(s["a"], F.array(p))).otherwise(s["a"]), lambda a: F.struct(
                a.alias("a"), F.concat(s["rss"], F.array(F.when(last(last(a)) > EXACT, last(last(a)) * last(size) * last(size)).otherwise(0.0))).alias("rss")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_P)), begin, step, lambda s: s["rss"])

    solved = each.select("series", "d", "n", "rows", "c", "q", F.posexplode(let(sizes(F.col("g")), left)).alias("p", "rss"))
    k = F.col("p") + F.col("q") + F.col("c") + 1
    return solved.select("series", "d", "n", "c", "p", "q", "rows", "rss",
                         *[v.alias(x) for x, v in criteria(gaussian(F.col("rss"), F.col("rows")), k, F.col("rows")).items()])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best(found: DataFrame) -> DataFrame:
    """The candidate of lowest AICc of each series; ties go to fewer terms, then to fewer lags, then to no constant.
    One that leaves nothing to explain beats all others."""
    rank = F.when(F.col("rss") == 0, F.lit(float("-inf"))).otherwise(F.col("aicc"))
    return found.groupBy("series").agg(F.min_by(F.struct("c", "p", "q", "rss"), F.when(
        rank.isNotNull(), F.struct(rank, F.col("p") + F.col("q") + F.col("c"), "p", "c"))).alias("b")) \
        .where("b IS NOT NULL").select("series", "b.*")


# ---- estimation

def _terms(w: Column, t: Column, c: Column, p: Column, e: Column) -> Column:
    """What the parameters multiply at the 0-based period t: 1, the p values before, the q innovations before (``e``, newest first)."""
    return F.concat(F.array_repeat(F.lit(1.0), c), F.reverse(F.slice(w, t - p + 1, p)), e)


def _times(p: Column, n: Column) -> Column:
    """0-based periods that are predicted: all but the first p."""
    return F.when(n > p, F.sequence(p, n - 1)).otherwise(none("int"))


def _newest(x: Column, before: Column, size: Column) -> Column:
    """x ahead of the others, ``size`` in all."""
    return F.slice(F.concat(F.array(x), before), 1, size)


def products(w: Column, n: Column, c: Column, p: Column, q: Column, b: Column) -> Column:
    """Matrix of summed products of the predictions' derivatives and the innovations, at parameters ``b``.

    The first p values are given and earlier innovations are 0. The derivatives follow the innovations'
    recursion: terms less the moving average of the derivatives before.
    """
    k, theta = c + p + q, F.slice(b, c + p + 1, q)
    flat = F.array_repeat(F.lit(0.0), k)
    zero = F.struct(F.array_repeat(F.lit(0.0), q).alias("e"), F.array_repeat(flat, q).alias("u"),
                    F.array_repeat(F.array_repeat(F.lit(0.0), k + 1), k + 1).alias("g"))

    def step(s: Column, t: Column) -> Column:
        def at_terms(x: Column) -> Column:
            u = F.aggregate(F.arrays_zip(theta.alias("a"), s["u"].alias("u")), x, lambda v, r: F.zip_with(v, r["u"], lambda y, z: y - r["a"] * z))
            return let(F.struct((at(w, t) - dot(b, x)).alias("e"), u.alias("u")), lambda r: F.struct(
                _newest(r["e"], s["e"], q).alias("e"), _newest(r["u"], s["u"], q).alias("u"),
                let(F.concat(r["u"], F.array(r["e"])), lambda z: add_outer(s["g"], z)).alias("g")))
        return let(_terms(w, t, c, p, s["e"]), at_terms)

    return F.aggregate(_times(p, n), zero, step, lambda s: s["g"])


def _rss(g: Column) -> Column:
    return last(last(g))


def css(w: Column, n: Column, c: Column, p: Column, q: Column, start: Column) -> Column:
    """struct(b, g): parameters of least conditional sum of squares and the products there.

    Levenberg's damping: a step that lessens the sum is taken and the damping lowered, another is refused and
    it is raised; from a sum that falls by less than 1e-14 of itself on, or beyond a damping of 1e10, all stays
    as is. Starts from ``start`` or, where that is no better, from the mean alone.
    """
    k = c + p + q

    def state(b: Column, g: Column, damp: Column, done: Column) -> Column:
        return F.struct(b.alias("b"), g.alias("g"), damp.alias("damp"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        damped = F.transform(s["g"], lambda row, i: F.transform(row, lambda v, j: F.when((i == j) & (i < k), v * (1.0 + s["damp"])).otherwise(v)))
        moved = F.zip_with(s["b"], solve(damped, upto(k))["coef"], lambda x, d: x + F.coalesce(d, F.lit(0.0)))

        def judged(y: Column) -> Column:
            return F.when(_rss(y["g"]) < _rss(s["g"]), state(y["b"], y["g"], s["damp"] / 10.0, _rss(s["g"]) - _rss(y["g"]) <= 1e-14 * _rss(s["g"]))) \
                .otherwise(state(s["b"], s["g"], s["damp"] * 10.0, s["damp"] > 1e10))
        return F.when(s["done"], s).otherwise(let(let(moved, lambda b: F.struct(b.alias("b"), products(w, n, c, p, q, b).alias("g"))), judged))

    mean = F.aggregate(w, F.lit(0.0), lambda a, v: a + v) / F.greatest(n, F.lit(1))
    plain = F.concat(F.array_repeat(mean, c), F.array_repeat(F.lit(0.0), p + q))
    tried = F.transform(F.array(plain, start), lambda b: F.struct(b.alias("b"), products(w, n, c, p, q, b).alias("g")))
    begin = let(tried, lambda x: F.when(_rss(at(x, 1)["g"]) < _rss(at(x, 0)["g"]), at(x, 1)).otherwise(at(x, 0)))
    begin = let(begin, lambda x: state(x["b"], x["g"], F.lit(1e-3), k == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step, lambda s: F.struct(s["b"].alias("b"), s["g"].alias("g")))


# ---- fitted values and forecasts

def innovations(w: Column, n: Column, c: Column, p: Column, q: Column, b: Column) -> Column:
    """Innovations of all n periods; 0 for the first p."""
    zero = F.struct(F.array_repeat(F.lit(0.0), q).alias("e"), none().alias("all"))

    def step(s: Column, t: Column) -> Column:
        return let(at(w, t) - dot(b, _terms(w, t, c, p, s["e"])), lambda e: F.struct(
            _newest(e, s["e"], q).alias("e"), F.concat(s["all"], F.array(e)).alias("all")))

    return F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.least(p, n), F.lit(0))), F.aggregate(_times(p, n), zero, step, lambda s: s["all"]))


def running(values: Column, first: Column) -> Column:
    """Running sums from ``first`` on."""
    zero = F.struct(first.alias("s"), none().alias("all"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["all"], F.array(a["s"] + v)).alias("all")),
                       lambda a: a["all"])


def _latest(values: Column, size: Column) -> Column:
    """The last ``size`` values, newest first; 0 beyond the first."""
    return F.slice(F.concat(F.reverse(values), F.array_repeat(F.lit(0.0), size)), 1, size)


def ahead(w: Column, e: Column, c: Column, p: Column, q: Column, b: Column, h: int) -> Column:
    """h forecasts of the differenced series."""
    zero = F.struct(_latest(w, p).alias("w"), _latest(e, q).alias("e"), none().alias("all"))

    def step(s: Column, _: Column) -> Column:
        return let(dot(b, F.concat(F.array_repeat(F.lit(1.0), c), s["w"], s["e"])), lambda v: F.struct(
            _newest(v, s["w"], p).alias("w"), _newest(F.lit(0.0), s["e"], q).alias("e"), F.concat(s["all"], F.array(v)).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(h)), zero, step, lambda s: s["all"])


def undifferenced(values: Column, x: Column, d: Column) -> Column:
    """Forecasts of the series from those of its d-th differences."""
    change = last(x) - F.coalesce(F.try_element_at(x, F.lit(-2)), F.lit(0.0))
    starts = F.slice(F.array(change, last(x)), 3 - d, d)          # the last values of the lower differences, highest first
    return F.aggregate(starts, values, running)


def forecast_errors(b: Column, c: Column, d: Column, p: Column, q: Column, sigma2: Column, h: int) -> Column:
    """Standard errors of forecasts 1 to h: psi weights of the ARMA part, summed up d times."""
    phi, theta = F.slice(b, c + 1, p), F.slice(b, c + p + 1, q)
    zero = F.struct(F.array_repeat(F.lit(0.0), p).alias("late"), none().alias("all"))

    def step(s: Column, j: Column) -> Column:
        own = F.when(j == 0, F.lit(1.0)).otherwise(F.coalesce(F.get(theta, j - 1), F.lit(0.0)))
        return let(own + dot(phi, s["late"]), lambda v: F.struct(_newest(v, s["late"], p).alias("late"), F.concat(s["all"], F.array(v)).alias("all")))

    psi = F.aggregate(F.sequence(F.lit(0), F.lit(h - 1)), zero, step, lambda s: s["all"])
    whole = F.aggregate(upto(d), psi, lambda v, _: running(v, F.lit(0.0)))
    return F.transform(running(F.transform(whole, lambda v: v * v), F.lit(0.0)), lambda v: F.sqrt(sigma2 * v))


def as_arrays(w: DataFrame) -> DataFrame:
    """One row a series: d, n and the arrays idx, x and w (the last without its first d periods)."""
    rows = w.groupBy("series", "d", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "w"))).alias("r"))
    return rows.select("series", "d", "n", F.col("r.idx").alias("idx"), F.col("r.x").alias("x"),
                       F.slice(F.col("r.w"), F.col("d") + 1, F.greatest(F.col("n"), F.lit(0))).alias("w")).repartition(_parts(w), "series")


def paths(fitted: DataFrame, h: int) -> DataFrame:
    """(series, idx, kind, value, std_error) from rows of ``as_arrays`` with c, p, q, b and sigma2: fitted values
    of all periods (the value itself where it is given) and h forecasts with their standard errors."""
    w, n, b, sigma2, d, c, p, q = (F.col(x) for x in ("w", "n", "b", "sigma2", "d", "c", "p", "q"))
    e = fitted.withColumn("e", innovations(w, n, c, p, q, b))
    e = materialize(e.select("series", "idx", "x", "d", "e", undifferenced(ahead(w, F.col("e"), c, p, q, b, h), F.col("x"), d).alias("f"),
                             forecast_errors(b, c, d, p, q, sigma2, h).alias("se")))
    past = e.select("series", F.explode(F.arrays_zip("idx", "x", F.concat(F.array_repeat(F.lit(0.0), F.col("d")), "e").alias("e"))).alias("r")) \
        .select("series", "r.idx", F.lit("fitted").alias("kind"), (F.col("r.x") - F.col("r.e")).alias("value"), F.lit(None).cast("double").alias("std_error"))
    future = e.select("series", F.array_max("idx").alias("last"), F.posexplode(F.arrays_zip("f", "se")).alias("k", "r")) \
        .select("series", (F.col("last") + F.col("k") + 1).alias("idx"), F.lit("forecast").alias("kind"), F.col("r.f").alias("value"), F.col("r.se").alias("std_error"))
    return past.unionByName(future)


def arima(df: DataFrame, series: str = "series", idx: str = "idx", value: str = "value", h: int = 6) -> tuple[DataFrame, DataFrame]:
    """T10-T12 for every series -> (models, path).

    models: one row a series with the columns ``MODEL_COLS``; status is ``ok``, ``exact`` (the chosen model leaves
    nothing to explain, as for a constant series) or ``short`` (too few periods to compare orders: p = q = 0, and a
    mean where d = 0). Where the residual variance is 0 there is no likelihood. path: fitted values and forecasts (``paths``).
    """
    w = materialize(differenced(df, series, idx, value))
    sums = materialize(regressions(w))
    chosen = materialize(best(candidates(sums)))
    rows = as_arrays(w).join(chosen, "series", "left").join(sums.select("series", "g"), "series", "left") \
        .withColumn("status", F.when(F.col("rss") > 0, "ok").when(F.col("rss") == 0, "exact").otherwise("short")) \
        .withColumn("c", F.coalesce("c", (F.col("d") == 0).cast("int"))).withColumns({x: F.coalesce(x, F.lit(0)) for x in ("p", "q")})
    c, p, q, n = F.col("c"), F.col("p"), F.col("q"), F.col("n")
    regressed = F.filter(solve(F.col("g"), pivots(c, p, q))["coef"], lambda v: v.isNotNull())
    start = F.when(F.size(regressed) == c + p + q, regressed).otherwise(F.array_repeat(F.lit(0.0), c + p + q))
    fit = rows.withColumn("start", start).repartition(_parts(df), "series").withColumn("fit", css(F.col("w"), n, c, p, q, F.col("start")))
    fit = materialize(fit.select("series", "d", "n", "idx", "x", "w", "c", "p", "q", "status", F.col("fit.b").alias("b"), F.col("fit.g").alias("g")))
    n_used = F.greatest(n - p, F.lit(0))
    # A sum of squares that only rounding leaves is none.
    scale = F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)
    fit = fit.withColumn("rss", F.when(_rss(F.col("g")) > 1e-20 * scale, _rss(F.col("g"))).otherwise(0.0)) \
        .withColumn("sigma2", F.coalesce(F.try_divide("rss", n_used), F.lit(0.0))) \
        .withColumn("se", F.transform(solve(F.col("g"), upto(c + p + q))["inverse"], lambda v: F.sqrt(F.col("sigma2") * v)))
    loglik = gaussian(F.col("rss"), n_used)
    models = fit.select(
        "series", "p", "d", "q", F.coalesce(F.get(F.slice("b", 1, c), F.lit(0)), F.lit(0.0)).alias("const"), F.slice("b", c + 1, p).alias("ar"),
        F.slice("b", c + p + 1, q).alias("ma"), F.get(F.slice("se", 1, c), F.lit(0)).alias("const_se"), F.slice("se", c + 1, p).alias("ar_se"),
        F.slice("se", c + p + 1, q).alias("ma_se"), "sigma2", loglik.alias("loglik"),
        *[v.alias(x) for x, v in criteria(loglik, c + p + q + 1, n_used).items()], n_used.cast("long").alias("n_used"), "status")
    path = paths(fit.select("series", "d", "n", "idx", "x", "w", "c", "p", "q", "b", "sigma2"), h)
    return models.withColumnRenamed("series", series), path.withColumnsRenamed({"series": series, "idx": idx})


def apply_model(df: DataFrame, d: int, const: float, ar: list[float], ma: list[float], h: int = 6, series: str = "series",
                idx: str = "idx", value: str = "value") -> DataFrame:
    """T12 with given coefficients: every series' ``paths``; the residual variance is the series' own."""
    own, x = Window.partitionBy("series").orderBy("idx"), F.col("x")
    changes = [x, x - F.lag("x").over(own), x - 2 * F.lag("x").over(own) + F.lag("x", 2).over(own)]
    rows = df.select(F.col(series).alias("series"), F.col(idx).cast("int").alias("idx"), F.col(value).cast("double").alias("x"))
    rows = rows.select("series", "idx", "x", changes[d].alias("w"), F.lit(d).alias("d"),
                       (F.count("*").over(Window.partitionBy("series")) - d).cast("int").alias("n"))
    a = as_arrays(rows).withColumns({"c": F.lit(1), "p": F.lit(len(ar)), "q": F.lit(len(ma)),
                                     "b": F.array(*[F.lit(float(v)) for v in (const, *ar, *ma)])})
    e = innovations(*[F.col(x) for x in ("w", "n", "c", "p", "q", "b")])
    a = a.withColumn("sigma2", F.try_divide(F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v), F.greatest(F.col("n") - F.col("p"), F.lit(0))))
    return paths(a, h).withColumnsRenamed({"series": series, "idx": idx})
