"""Time-series operators over a long ``(series, idx, value)`` table: every
operator handles all series in one job, grouped or joined on the series key."""

from tessera.operators.series.accuracy import accuracy, best_model  # noqa: F401
from tessera.operators.series.smooth import ses_fitted, ses_grid, ses_levels  # noqa: F401
from tessera.operators.series.stats import acf, adf, kpss, lags, ljung_box, pacf  # noqa: F401
