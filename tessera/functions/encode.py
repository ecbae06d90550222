"""Categorical encodings.

Level sets are data: they are found with one small distributed job
(``distinct`` on one column) whose size is checked before anything is
brought to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import clean_name

MAX_LEVELS = 1000


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values of a low-cardinality column (checked bound)."""
    rows = (df.select(col).where(F.col(col).isNotNull()).distinct()
              .limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"column {col!r} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def levels_many(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted level sets of several columns from ONE pass: (column, value) pairs
    are stacked and de-duplicated in a distributed aggregate; at most
    ``len(cols) * max_levels + 1`` pairs are brought back (checked bound)."""
    cols = list(cols)
    pairs = (df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p"))
               .select("p.c", "p.v").where(F.col("v").isNotNull()).distinct())
    rows = pairs.limit(len(cols) * max_levels + 1).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, v in out.items():
        if len(v) > max_levels:
            raise ValueError(f"column {c!r} has more than {max_levels} levels")
        v.sort()
    return out


def encode_categoricals(df: DataFrame, binary: Sequence[str], multi: Sequence[str],
                        max_levels: int = MAX_LEVELS) -> DataFrame:
    """X13 + R2 with every level set found in one pass, then one projection:
    two-level columns -> 1 for the first sorted level; multi-level columns ->
    treatment dummies (first level dropped)."""
    lv = levels_many(df, list(binary) + list(multi), max_levels)
    out = df.withColumns({c: binary_level(F.col(c).cast("string"), lv[c][0] if lv[c] else None) for c in binary})
    dummy_cols = {}
    for c in multi:
        dummy_cols.update(dummy_columns(c, lv[c], True))
    return out.withColumns(dummy_cols).drop(*multi)


def binary_level(x, first_level) -> Column:
    """Alphabetically first level -> 1, the other -> 0 (NULL stays NULL)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull(), F.lit(None)).when(c == F.lit(first_level), 1).otherwise(0)


def binary_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """X13 on several two-level columns: one ``min`` aggregate finds every first level."""
    firsts = df.agg(*[F.min(c).alias(c) for c in cols]).collect()[0]
    return df.withColumns({c: binary_level(c, firsts[c]) for c in cols})


def dummy_columns(col: str, lvls: Sequence, drop_first: bool = True) -> dict[str, Column]:
    """R2: treatment coding, one 0/1 column per level named ``col+level``."""
    use = list(lvls)[1:] if drop_first else list(lvls)
    return {clean_name(f"{col}{lv}"): F.when(F.col(col) == F.lit(lv), 1).otherwise(0) for lv in use}


def dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
            keep_source: bool = False) -> DataFrame:
    """R2 on several columns: levels found once, then one projection."""
    out = df
    for c in cols:
        out = out.withColumns(dummy_columns(c, levels(df, c), drop_first))
    return out if keep_source else out.drop(*cols)


def factor_codes(df: DataFrame, col: str, code_col: str | None = None) -> DataFrame:
    """1-based code (long) of each value in sorted level order (R's factor codes).

    The distinct values are range-partitioned and sorted, numbered inside each
    partition, and shifted by the sizes of the partitions before (one number per
    partition reaches the driver): no task sees all levels, whatever their number.
    """
    from tessera.session import materialize

    code_col = code_col or f"{col}_code"
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    parts = materialize(distinct.repartitionByRange(col).withColumn("__p", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(parts.groupBy("__p").count().collect(), key=lambda r: r["__p"]):
        offsets.append((r["__p"], before))
        before += r["count"]
    at = parts.sparkSession.createDataFrame(offsets, "__p int, __before long")      # one row per partition
    w = Window.partitionBy("__p").orderBy(col)
    lv = parts.join(F.broadcast(at), "__p").select(col, (F.col("__before") + F.row_number().over(w)).alias(code_col))
    return df.join(lv, on=col, how="left")
