"""Column profiles (A1-A4, A14-A17). Every profile is ONE aggregate pass over
all requested columns; results come back long: one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else list(df.columns)


def _long(wide: DataFrame, cols: Sequence[str], value: str, name: str = "column_name") -> DataFrame:
    return wide.unpivot([], list(cols), name, value)


def distinct_count(df: DataFrame, col: str, count_null: bool = True, approx: float | None = None) -> DataFrame:
    """A1: number of distinct values; a NULL counts as one more value (R ``unique``).

    ``approx`` (a relative standard deviation, e.g. 0.01) switches to the
    HyperLogLog++ sketch: fixed memory per task instead of a distinct shuffle.
    """
    n = F.approx_count_distinct(col, approx) if approx else F.count_distinct(col)
    if count_null:
        n = n + F.max(F.col(col).isNull().cast("int"))
    return df.agg(n.cast("long").alias("n_distinct"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count of every column in one pass -> (column_name, null_count)."""
    cols = _cols(df, cols)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return _long(wide, cols, "null_count")


def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A4: rows that repeat an earlier row on ``keys`` (all columns by default).

    One shuffle on the key (partial counts map-side), then a global sum.
    """
    keys = _cols(df, keys)
    return (df.groupBy(*keys).count()
              .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates")))


def zero_or_null_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of cells equal to zero or NULL, per column, in one pass.

    A text column compares with ``"0"`` as text (R compares a frame with 0 so).
    """
    cols = _cols(df, cols)
    types = dict(df.dtypes)
    exprs = []
    for c in cols:
        zero = F.lit("0") if types[c] == "string" else F.lit(0)
        hit = F.col(c).isNull() | (F.col(c) == zero)
        exprs.append(F.avg(F.coalesce(hit, F.lit(True)).cast("double")).alias(c))
    return _long(df.agg(*exprs), cols, "zero_or_null_share")


def sparse_columns(df: DataFrame, threshold: float = 0.4, cols: Sequence[str] | None = None) -> DataFrame:
    """The profile with the drop decision (share strictly above ``threshold``)."""
    return (zero_or_null_share(df, cols)
            .withColumn("dropped", F.col("zero_or_null_share") > F.lit(threshold)))


def drop_sparse(df: DataFrame, threshold: float = 0.4, cols: Sequence[str] | None = None) -> DataFrame:
    """A15 projection: a one-row-per-column profile is read, then columns dropped.
    When none qualifies nothing is dropped (N11)."""
    drop = [r["column_name"] for r in sparse_columns(df, threshold, cols).collect() if r["dropped"]]
    return df.drop(*drop)


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column min / max, NULL share and blank share in one pass.

    ``constant`` = one value and no NULL, or all NULL. min / max are mergeable,
    so the pass is map-side combined (no distinct-count shuffle).
    """
    cols = _cols(df, cols)
    types = dict(df.dtypes)
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        s = F.col(c).cast("string")
        exprs += [
            F.min(c).cast("string").alias(f"mn{i}"), F.max(c).cast("string").alias(f"mx{i}"),
            F.sum(F.col(c).isNull().cast("long")).alias(f"nl{i}"),
            F.sum((F.trim(s) == "").cast("long") if types[c] == "string" else F.lit(0)).alias(f"bl{i}"),
        ]
    wide = df.agg(*exprs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"mn{i}").alias("min_value"),
                 F.col(f"mx{i}").alias("max_value"), F.col(f"nl{i}").alias("nulls"),
                 F.col(f"bl{i}").alias("blanks"))
        for i, c in enumerate(cols)]))
    long = wide.select(F.col("__n").alias("n"), stack.alias("s")).select("n", "s.*")
    return long.select(
        "column_name", "min_value", "max_value",
        F.round(F.col("nulls") / F.col("n"), 6).alias("null_share"),
        F.round(F.col("blanks") / F.col("n"), 6).alias("blank_share"),
        ((F.col("nulls") == F.col("n"))
         | ((F.col("nulls") == 0) & (F.col("min_value") == F.col("max_value")))).alias("constant"),
    )


def frequency(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Counts per level (or per pair of levels)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def column_summary(df: DataFrame, cols: Sequence[str], exact: bool = True,
                   accuracy: int = 10_000) -> DataFrame:
    """Min, quartiles (R type 7 = linear interpolation), mean, max per column.

    Minimum, mean and maximum (and, with ``exact=False``, ``percentile_approx``) are
    aggregates of the columns in place, one pass, one row that is unpivoted. For
    ``exact`` the columns are stacked and grouped by name, for the bounded-memory
    exact quantiles of quantile.py.
    """
    cells = {c: F.col(c).cast("double") for c in cols}
    some = [] if exact else [lambda v: F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("__q")]
    wide = df.agg(*[F.struct(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), *[f(v) for f in some]).alias(f"c{i}")
                    for i, v in enumerate(cells.values())])
    basic = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("s")) for i, c in enumerate(cells)
    ])).alias("r")).select("r.column_name", "r.s.*")
    if not exact:
        return basic.select("column_name", "min", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), "mean",
                            F.col("__q")[2].alias("q3"), "max")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("s")).select("s.*")
    from tessera.operators.quantile import exact_quantiles

    q = exact_quantiles(long, ["column_name"], "v", [0.25, 0.5, 0.75]).select(
        "column_name", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    return basic.join(q, "column_name").select("column_name", "min", "q1", "median", "mean", "q3", "max")


def null_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of NULL cells per column, one pass -> (column_name, null_share)."""
    cols = _cols(df, cols)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return _long(wide, cols, "null_share")


def drop_mostly_null(df: DataFrame, threshold: float = 0.9, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns whose NULL share exceeds ``threshold`` (a postal code
    that is almost always missing); the one-row-per-column profile is read first."""
    drop = [r["column_name"] for r in null_share(df, cols).collect()
            if r["null_share"] is not None and r["null_share"] > threshold]
    return df.drop(*drop)


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, at_once: int = 12) -> list[dict]:
    """A15 + A16 together: per column the zero-or-NULL share, NULL and blank shares and
    whether it is constant (read on the driver: one small row a pass).

    A pass takes ``at_once`` columns, so that its generated code stays small enough to be
    compiled; of a written table each column is still read once. A column is constant if no
    cell differs from the first row's.
    """
    cols = _cols(df, cols)
    types = dict(df.dtypes)
    first = df.select(*cols).first()
    out = []
    for lo in range(0, len(cols), at_once):
        some = cols[lo: lo + at_once]
        exprs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(some):
            text = types[c] == "string"
            same = F.col(c) == F.lit(first[c] if first else None).cast(types[c])
            exprs += [F.count(c).alias(f"v{i}"), F.count_if(F.col(c) == F.lit("0" if text else 0)).alias(f"z{i}"),
                      F.count_if(~same).alias(f"d{i}")]
            if text:
                exprs.append(F.count_if(F.trim(F.col(c)) == "").alias(f"bl{i}"))
        r = df.select(*some).agg(*exprs).first().asDict()
        n = r["__n"]
        for i, c in enumerate(some):
            nulls = n - r[f"v{i}"]
            one = first is not None and first[c] == first[c] and r[f"d{i}"] == 0       # NaN is no constant
            out.append({"column_name": c, "zero_or_null_share": (nulls + r[f"z{i}"]) / n if n else None,
                        "null_share": nulls / n if n else None, "blank_share": r.get(f"bl{i}", 0) / n if n else None,
                        "constant": nulls == n or (nulls == 0 and one)})
    return out


def drop_profiled(df: DataFrame, sparse_threshold: float = 0.4, blank_threshold: float = 0.4) -> DataFrame:
    """A15 + A16 projection from one profile: drop columns whose zero-or-NULL
    share exceeds ``sparse_threshold``, constant columns, and columns whose blank
    share exceeds ``blank_threshold``. None qualifying drops nothing (N11)."""
    drop = [p["column_name"] for p in column_profile(df)
            if (p["zero_or_null_share"] is not None and p["zero_or_null_share"] > sparse_threshold)
            or p["constant"] or (p["blank_share"] is not None and p["blank_share"] > blank_threshold)]
    return df.drop(*drop)


def drop_uninformative(df: DataFrame, blank_threshold: float = 0.4,
                       cols: Sequence[str] | None = None) -> DataFrame:
    """A16 projection: drop constant columns and columns whose blank share
    exceeds ``blank_threshold`` (decided from the one-pass profile)."""
    prof = constant_columns(df, cols).collect()
    drop = [r["column_name"] for r in prof
            if r["constant"] or (r["blank_share"] is not None and r["blank_share"] > blank_threshold)]
    return df.drop(*drop)
