"""DataFrame -> DataFrame operators.

profile    one-pass column profiles and the data-dependent drops they drive
relate     null-safe equi-joins, size-checked broadcast lookups, parameter grids
reshape    unpivot, per-group order index, holdout flags, labelled unions
rank       top-n, rank within group, best row per group (skew-safe ``min_by``)
aggregate  grouped aggregates, scores, histogram, box statistics, trends, correlations
quantile   exact grouped quantiles with bounded memory
sample     key-hash splits, folds and samples
gram       sufficient statistics of linear models (one pass)
regress    OLS, inference, stepwise AIC, VIF, backward elimination, scoring
classify   linear SVM, random-Fourier-feature RBF approximation, CV grid
metrics    confusion counts, class metrics, exact intervals
series     smoothing, ACF / PACF, KPSS, ADF, Ljung-Box, trend + season fit, ARIMA, accuracy
"""
