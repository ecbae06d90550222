"""Forecast accuracy and model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, keys: Sequence[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """ME, RMSE, MAE, MPE, MAPE per key in one aggregate (MAPE is the 5th)."""
    e = F.col(actual) - F.col(forecast)
    pe = F.try_divide(F.lit(100.0) * e, F.col(actual))      # an actual of 0 has no percentage
    return df.groupBy(*keys).agg(
        F.avg(e).alias("me"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(pe).alias("mpe"), F.avg(F.abs(pe)).alias("mape"), F.count(F.lit(1)).alias("n_test"))


def best_model(acc: DataFrame, series: str = "series", model: str = "model", metric: str = "mape") -> DataFrame:
    """The model with the lowest metric per series (ties: model name)."""
    return acc.groupBy(series).agg(
        F.min_by(F.struct(F.col(metric), F.col(model)), F.struct(F.col(metric), F.col(model)))
         .alias("__b")).select(series, F.col(f"__b.{model}").alias("best_model"),
                               F.col(f"__b.{metric}").alias(metric))
