"""Linear models on sufficient statistics.

Every fit below reads a ``Gram`` (two aggregates over the data, see gram.py)
and solves a small system on the driver; scoring is a Spark projection with
the coefficients as literals, and holdout R^2 is one ``corr`` aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.gram import Gram


# ------------------------------------------------------------ distributions
LARGE_DF = 1e6        # degrees of freedom from which the limiting distributions serve


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b): x^a (1 - x)^b / (a B(a, b)) over the continued fraction

    1 + d_1 / (1 + d_2 / (1 + ...)), d_2m = m (b - m) x / ((a + 2m - 1)(a + 2m)),
    d_2m+1 = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1)),

    which closes in fast below the mean a / (a + b); above it I_x(a, b) = 1 - I_(1-x)(b, a) is used.
    """
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_below(b, a, 1.0 - x)
    return _beta_below(a, b, x)


def _beta_below(a: float, b: float, x: float) -> float:
    top, top_before, bottom, bottom_before, value = 1.0, 1.0, 1.0, 0.0, 1.0
    for k in range(1, 100_000):
        m = k // 2
        d = m * (b - m) * x / ((a + k - 1.0) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1.0) * (a + k))
        top, top_before = top + d * top_before, top
        bottom, bottom_before = bottom + d * bottom_before, bottom
        # Only the ratio counts: both are kept near 1.
        top, top_before, bottom, bottom_before = top / bottom, top_before / bottom, 1.0, bottom_before / bottom
        if abs(top - value) <= 1e-16 * abs(top):
            break
        value = top
    front = math.lgamma(a + b) - math.lgamma(a + 1.0) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / top


def t_two_sided_p(t: float, df: float) -> float:
    if df <= 0 or not math.isfinite(t):
        return float("nan") if not math.isfinite(t) else 1.0
    if df > LARGE_DF:                # the normal variable that t is nearest to
        return math.erfc(abs(t) * (1.0 - 0.25 / df) / math.sqrt(2.0 * (1.0 + t * t / (2.0 * df))))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def chi2_upper_p(q: float, df: int) -> float:
    """Upper chi-square tail by its finite sums."""
    x, have = q / 2.0, 2 - df % 2
    tail = math.exp(-x) if have == 2 else math.erfc(math.sqrt(x))
    while have < df and x > 0:
        tail += math.exp(-x + have / 2.0 * math.log(x) - math.lgamma(have / 2.0 + 1.0))
        have += 2
    return min(tail, 1.0)


def f_upper_p(f: float, d1: float, d2: float) -> float:
    if d1 <= 0 or d2 <= 0 or not math.isfinite(f) or f < 0:
        return float("nan")
    if d2 > LARGE_DF:
        return chi2_upper_p(f * d1, int(d1))
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


# ------------------------------------------------------------------ fitting
@dataclass
class Fit:
    response: str
    terms: list[str]                 # predictors kept (collinear ones dropped)
    dropped: list[str]
    intercept: float
    coef: np.ndarray
    se: np.ndarray
    intercept_se: float
    rss: float
    tss: float
    n: int
    extra: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.terms) + 1

    @property
    def df_resid(self) -> int:
        return self.n - self.k

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def aic(self) -> float:
        return aic_of(self.rss, self.k - 1, self.n)

    @property
    def f_stat(self) -> float:
        p = len(self.terms)
        if p == 0 or self.df_resid <= 0:
            return float("nan")
        return ((self.tss - self.rss) / p) / self.sigma2

    def p_values(self) -> np.ndarray:
        return np.array([t_two_sided_p(b / s, self.df_resid) if s > 0 else float("nan")
                         for b, s in zip(self.coef, self.se)])


def aic_of(rss: float, n_terms: int, n: int) -> float:
    """extractAIC form: n log(RSS/n) + 2k (k coefficients incl. intercept)."""
    return n * math.log(max(rss, 1e-300) / n) + 2 * (n_terms + 1)


def _independent(g: Gram, terms: Sequence[str], tol: float) -> tuple[list[int], list[str]]:
    """Indices of the terms that aren't, to ``tol`` of their variance, combinations of
    those kept before, and the names of the others: a Cholesky factor grown by a row a term."""
    keep, dropped = [], []
    lower = np.zeros((len(terms), len(terms)))
    for t in terms:
        i, k = g.index(t), len(keep)
        row = np.zeros(k)
        for j in range(k):
            row[j] = (g.cross[keep[j], i] - lower[j, :j] @ row[:j]) / lower[j, j]
        rest = g.cross[i, i] - row @ row
        if g.cross[i, i] <= 0 or rest < tol * g.cross[i, i]:
            dropped.append(t)
            continue
        lower[k, :k], lower[k, k] = row, math.sqrt(rest)
        keep.append(i)
    return keep, dropped


def ols(g: Gram, response: str, terms: Sequence[str], tol: float = 1e-9) -> Fit:
    """L2 + L3 from centred statistics; collinear terms are dropped in order
    (a pivot on the scaled diagonal), as a rank-deficient ``lm`` reports NA."""
    yi = g.index(response)
    keep, dropped = _independent(g, terms, tol)
    syy = g.cross[yi, yi]
    if keep:
        sxx = g.cross[np.ix_(keep, keep)]
        sxy = g.cross[keep, yi]
        inv = np.linalg.inv(sxx)
        beta = inv @ sxy
        rss = max(float(syy - sxy @ beta), 0.0)
    else:
        inv = np.zeros((0, 0))
        beta = np.zeros(0)
        rss = float(syy)
    n = g.n
    k = len(keep) + 1
    s2 = rss / (n - k) if n > k else float("nan")
    se = np.sqrt(np.diag(inv) * s2) if keep else np.zeros(0)
    xm = g.mean[keep] if keep else np.zeros(0)
    b0 = float(g.mean[yi] - xm @ beta)
    se0 = math.sqrt(s2 * (1.0 / n + float(xm @ inv @ xm))) if keep else math.sqrt(s2 / n)
    return Fit(response, [g.names[i] for i in keep], dropped, b0, beta, se, se0, rss, float(syy), n)


def vif(g: Gram, terms: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix of the predictors
    (= 1 / (1 - R^2_j) of each predictor on the others)."""
    idx = [g.index(t) for t in terms]
    sub = g.cross[np.ix_(idx, idx)]
    d = np.sqrt(np.diag(sub))
    corr = sub / np.outer(d, d)
    inv = np.linalg.pinv(corr)
    return {t: float(inv[i, i]) for i, t in enumerate(terms)}


def _move_rss(g: Gram, fit: Fit, scope: Sequence[str], tol: float = 1e-9) -> list[tuple[str, str, float]]:
    """(move, term, residual sum of squares) of every drop and add, from one inverse:
    a drop adds b_j^2 / (inverse)_jj, an add takes off the squared partial product
    with the response over the term's partial variance."""
    keep, yi = [g.index(t) for t in fit.terms], g.index(fit.response)
    inv = np.linalg.inv(g.cross[np.ix_(keep, keep)]) if keep else np.zeros((0, 0))
    out = [("drop", t, fit.rss + fit.coef[j] ** 2 / inv[j, j]) for j, t in enumerate(fit.terms)]
    for t in scope:
        if t in fit.terms:
            continue
        i = g.index(t)
        x = g.cross[keep, i]
        own = g.cross[i, i] - x @ inv @ x
        if g.cross[i, i] > 0 and own >= tol * g.cross[i, i]:
            out.append(("add", t, max(fit.rss - (g.cross[i, yi] - x @ fit.coef) ** 2 / own, 0.0)))
    return out


def stepwise(g: Gram, response: str, terms: Sequence[str], direction: str = "both",
             max_steps: int = 1000) -> tuple[Fit, list[dict]]:
    """L4: stepwise search on AIC from the full model; each step weighs every
    drop (and every add when ``both``) and moves to the lowest AIC."""
    scope = list(terms)
    current = ols(g, response, scope)
    path = [{"step": 0, "move": "start", "term": None, "aic": current.aic, "n_terms": len(current.terms)}]
    for step in range(1, max_steps + 1):
        best, chosen = current.aic, None
        for move, t, rss in _move_rss(g, current, scope):
            if move == "add" and direction != "both":
                continue
            aic = aic_of(rss, len(current.terms) + (1 if move == "add" else -1), g.n)
            if aic < best - 1e-10:
                best, chosen = aic, (move, t)
        if chosen is None:
            break
        move, t = chosen
        current = ols(g, response, [x for x in current.terms if x != t] + ([t] if move == "add" else []))
        path.append({"step": step, "move": move, "term": t, "aic": current.aic, "n_terms": len(current.terms)})
    return current, path


def backward(g: Gram, response: str, terms: Sequence[str], vif_limit: float = 5.0,
             p_limit: float = 0.05) -> tuple[Fit, list[dict]]:
    """L6 as a rule: while a term is weak, drop the highest-VIF term above the
    limit whose p-value is above ``p_limit``; otherwise drop the highest p-value
    above ``p_limit``; stop when every term is significant."""
    cur = list(terms)
    steps = []
    while True:
        f = ols(g, response, cur)
        cur = list(f.terms)
        if not cur:
            break
        p = {t: float(x) for t, x in zip(cur, f.p_values())}
        v = vif(g, cur) if len(cur) > 1 else {cur[0]: 1.0}
        weak = [t for t in cur if p[t] > p_limit]
        if not weak:
            break
        high = [t for t in weak if v[t] > vif_limit]
        if high:
            t = max(high, key=lambda x: (v[x], x))
            reason = "vif"
        else:
            t = max(weak, key=lambda x: (p[x], x))
            reason = "p_value"
        steps.append({"step": len(steps) + 1, "dropped": t, "reason": reason, "vif": v[t], "p_value": p[t],
                      "n_terms_before": len(cur), "adj_r2_before": float(f.adj_r2)})
        cur = [x for x in cur if x != t]
    return ols(g, response, cur), steps


def coefficient_rows(fit: Fit) -> list[tuple]:
    """L3 table rows: (term, estimate, std_error, t_value, p_value)."""
    rows = [("(Intercept)", fit.intercept, fit.intercept_se,
             fit.intercept / fit.intercept_se if fit.intercept_se > 0 else float("nan"),
             t_two_sided_p(fit.intercept / fit.intercept_se, fit.df_resid) if fit.intercept_se > 0 else float("nan"))]
    for t, b, s, p in zip(fit.terms, fit.coef, fit.se, fit.p_values()):
        rows.append((t, float(b), float(s), float(b / s) if s > 0 else float("nan"), float(p)))
    return rows


def predict(df: DataFrame, fit: Fit, name: str = "predicted") -> Column:
    """The linear predictor as a Spark expression (coefficients as literals)."""
    expr = F.lit(fit.intercept)
    for t, b in zip(fit.terms, fit.coef):
        expr = expr + F.lit(float(b)) * F.col(t).cast("double")
    return expr.alias(name)


def holdout_r2(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Squared correlation of actual and predicted in one aggregate."""
    return df.agg(F.corr(actual, predicted).alias("r"), F.pow(F.corr(actual, predicted), 2).alias("r_squared"),
                  F.count(F.lit(1)).alias("n_test"))
