"""Numeric output helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x, digits: int) -> Column:
    """Round half away from zero on the binary value ``x * 10^digits``.

    Spark's ``round`` rounds the shortest decimal text of a double, so a value
    stored as 2.67499999... rounds up; this form rounds it down, the same as
    ``round(x * 10^d) / 10^d`` in C. Reports use it so that results are
    reproducible by any engine that rounds the binary value.
    """
    c = F.col(x) if isinstance(x, str) else x
    p = float(10 ** digits)
    return F.round(c * F.lit(p), 0) / F.lit(p)


def rnd_sig(x, digits: int) -> Column:
    """Round to ``digits`` significant digits (0 stays 0)."""
    c = F.col(x) if isinstance(x, str) else x
    e = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), e)
    return F.when(c == 0, F.lit(0.0)).otherwise(rnd(c / scale, digits - 1) * scale)


def rnd_sig_sql(x: str, digits: int) -> str:
    """The same as SQL text."""
    e = f"floor(log10(abs({x})))"
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / pow(10.0, {e}), {digits - 1}) * pow(10.0, {e}) END)"
