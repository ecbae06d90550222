"""Plain numpy versions of the series operators, one series at a time, for the tests."""

import math

import numpy as np

from tessera.operators.series.stats import ADF_CRIT, ADF_P, ADF_T, KPSS_CRIT, KPSS_P


def kpss_one(x):
    n = len(x)
    e = x - x.mean()
    s = np.cumsum(e)
    lag = int(math.trunc(3.0 * math.sqrt(n) / 13.0))
    s2 = float(e @ e) / n
    for k in range(1, lag + 1):
        s2 += 2.0 / n * (1.0 - k / (lag + 1.0)) * float(e[k:] @ e[:-k])
    stat = float(s @ s) / (n * n) / s2 if s2 > 0 else float("nan")
    return stat, float(np.interp(stat, KPSS_CRIT, KPSS_P)) if math.isfinite(stat) else float("nan")


def n_diffs(x):
    d, w = 0, x.copy()
    while d < 2 and len(w) > 4 and not np.allclose(w, w[0]) and kpss_one(w)[1] < 0.05:
        w, d = np.diff(w), d + 1
    return d


def pacf_one(r):
    k, out = len(r), []
    for i in range(1, k + 1):
        full = np.array([1.0, *r[:i]])
        m = np.array([[full[abs(a - b)] for b in range(i)] for a in range(i)])
        out.append(np.linalg.solve(m, r[:i])[-1])
    return np.array(out)


def chi2_sf(q, df):
    """By a fine sum of the regularised lower gamma function's series."""
    x, s = q / 2.0, df / 2.0
    if x <= 0:
        return 1.0
    return 1.0 - math.fsum(math.exp((s + k) * math.log(x) - x - math.lgamma(s + k + 1)) for k in range(2000))


def adf_p_value(stat, n):
    crit = [float(np.interp(n, ADF_T, [row[j] for row in ADF_CRIT])) for j in range(len(ADF_P))]
    return float(np.interp(stat, crit, ADF_P))


def adf_one(x, k=None):
    k = int(math.trunc((len(x) - 1) ** (1.0 / 3.0))) if k is None else k
    y = np.diff(x)
    n = len(y)
    if n - k < k + 4:
        return None, k, None
    rows = np.arange(k, n)
    m = np.column_stack([np.ones(len(rows)), x[rows], rows + 1.0, *[y[rows - j] for j in range(1, k + 1)]])
    beta, *_ = np.linalg.lstsq(m, y[rows], rcond=None)
    e = y[rows] - m @ beta
    stat = float(beta[1] / math.sqrt(float(e @ e) / (len(rows) - m.shape[1]) * np.linalg.inv(m.T @ m)[1, 1]))
    return stat, k, adf_p_value(stat, n)


def information_criteria(loglik, k, n):
    aic = -2.0 * loglik + 2.0 * k
    return aic, aic + 2.0 * k * (k + 1.0) / (n - k - 1.0), -2.0 * loglik + k * math.log(n)


def lagged(v, lags, rows):
    return np.column_stack([v[rows - i] for i in range(1, lags + 1)]) if lags else np.zeros((len(rows), 0))


def hr_candidates(w, d, top=5):
    """{(c, p, q): (rss, AICc)} of all candidates on the common sample."""
    n = len(w)
    m = min(top + 2, max(1, n // 4))
    rows = np.arange(m, n)
    e = np.zeros(n)
    x = np.column_stack([np.ones(len(rows)), lagged(w, m, rows)])
    e[rows] = w[rows] - x @ np.linalg.lstsq(x, w[rows], rcond=None)[0]
    rows = np.arange(m + top, n)
    out = {}
    for c in ((0, 1) if d < 2 else (0,)):
        for p in range(top + 1):
            for q in range(top + 1):
                x = np.column_stack([*[np.ones(len(rows))] * c, lagged(w, p, rows), lagged(e, q, rows)])
                y = w[rows]
                r = y - (x @ np.linalg.lstsq(x, y, rcond=None)[0] if x.shape[1] else 0)
                rss, k = float(r @ r), c + p + q + 1
                ll = -0.5 * len(rows) * (math.log(2 * math.pi * rss / len(rows)) + 1)
                out[c, p, q] = rss, (information_criteria(ll, k, len(rows))[1] if len(rows) - k - 1 > 0 else None)
    return out


def css_innovations(w, c, p, q, b):
    e = np.zeros(len(w))
    phi, theta = b[c:c + p], b[c + p:]
    for t in range(p, len(w)):
        e[t] = w[t] - (b[0] if c else 0) - sum(a * w[t - i] for i, a in enumerate(phi, 1)) \
            - sum(a * e[t - j] for j, a in enumerate(theta, 1) if t - j >= 0)
    return e


def css_fit(w, c, p, q, start):
    """Damped Gauss-Newton on numerical derivatives, to convergence: (b, sum of squares, standard errors)."""
    b = np.array(start, float)

    def derivatives(b):
        cols = []
        for i in range(len(b)):
            h = 1e-6 * max(1.0, abs(b[i]))
            step = np.eye(len(b))[i] * h
            cols.append((css_innovations(w, c, p, q, b + step) - css_innovations(w, c, p, q, b - step)) / (2 * h))
        return np.column_stack(cols)

    def rss(b):
        e = css_innovations(w, c, p, q, b)
        return float(e @ e)

    damp = 1e-3
    for _ in range(200 if len(b) else 0):
        j, e = derivatives(b), css_innovations(w, c, p, q, b)
        m = j.T @ j
        new = b - np.linalg.solve(m + damp * np.diag(np.diag(m)), j.T @ e)
        if rss(new) < rss(b):
            b, damp = new, damp / 10
        else:
            damp *= 10
            if damp > 1e8:
                break
    s2 = rss(b) / (len(w) - p)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(derivatives(b).T @ derivatives(b)))) if len(b) else np.zeros(0)
    return b, rss(b), se


def forecast(x, d, c, p, q, b, s2, h):
    """(forecasts, standard errors) of the series, by the recursions written out."""
    w = list(np.diff(x, n=d) if d else x)
    e = list(css_innovations(np.array(w), c, p, q, b))
    phi, theta = b[c:c + p], b[c + p:]
    fc = []
    for _ in range(h):
        v = (b[0] if c else 0) + sum(a * w[-i] for i, a in enumerate(phi, 1)) + sum(a * e[-j] for j, a in enumerate(theta, 1))
        w.append(v)
        e.append(0.0)
        fc.append(v)
    fc = np.array(fc)
    for k in range(d, 0, -1):
        fc = np.diff(x, n=k - 1)[-1] + np.cumsum(fc)
    # psi weights of phi(B) (1 - B)^d
    full = np.array([1.0, *(-phi)])
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    psi = [1.0]
    for j in range(1, h):
        psi.append((theta[j - 1] if j <= q else 0) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1)))
    return fc, np.sqrt(s2 * np.cumsum(np.square(psi)))
