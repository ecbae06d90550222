"""Date Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import replace_chars

# Fixed value: two-digit years below this pivot are 20xx, the rest 19xx (POSIX %y rule).
TWO_DIGIT_YEAR_PIVOT = 69
# English month abbreviations, in calendar order.
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_dmy(x, separators: str = "/") -> Column:
    """X5 + X7: ``dd-MM-yyyy`` text with mixed separators -> DATE; junk -> NULL."""
    unified = replace_chars(_c(x), separators, "-" * len(separators))
    return F.try_to_timestamp(unified, F.lit("d-M-yyyy")).cast("date")


def parse_month_year(x, pivot: int = TWO_DIGIT_YEAR_PIVOT) -> Column:
    """``"Dec-11"`` -> first day of that month (2011-12-01).

    The month name is a literal-map lookup (case-insensitive) and the year is
    read with the POSIX pivot (``00-68`` -> 20xx, ``69-99`` -> 19xx), which
    Spark's ``yy`` pattern (base 2000) does not do. No per-row date parsing.
    """
    parts = F.split(F.trim(_c(x)), "-", 2)
    months = F.create_map(*[v for i, m in enumerate(MONTH_ABBREVIATIONS) for v in (F.lit(m), F.lit(i + 1))])
    month = F.try_element_at(months, F.lower(F.trim(F.get(parts, 0))))
    ys = F.trim(F.get(parts, 1))
    yy = ys.try_cast("int")
    year = F.when(F.length(ys) > 2, yy).otherwise(yy + F.when(yy < pivot, 2000).otherwise(1900))
    return F.make_date(year, month, F.lit(1))                  # NULL where the month or the year is


def year_month(x) -> Column:
    """``YYYY-MM`` text of a date."""
    return F.date_format(_c(x), "yyyy-MM")


def month_start(x) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(_c(x).cast("date"), "month")
