"""Exact grouped quantiles with bounded memory.

``percentile`` keeps every distinct value of a group in one buffer, which is
unbounded for a continuous column in a hot group. Here:

  pass 1  per group: n, min, max and ``percentile_approx`` at p -/+ eps, which
          bracket the two order statistics an exact quantile interpolates;
  pass 2  one aggregate keyed by (group, value-if-inside-a-bracket): the
          counts of the bracket's distinct values, and for every probability
          the number of values below its bracket (rows outside all brackets
          fold into one NULL key per group, map-side).

Only bracket values are ever ordered: about 2 eps n of them (eps = 4 /
accuracy) for a large group; a group smaller than 2 accuracy is bracketed by
its own min and max (at most 2 accuracy values). Memory is set by
``accuracy``, not by the group size. Result: type-7 quantiles (linear
interpolation between order statistics at p (n - 1)), as R's default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000


def exact_quantiles(df: DataFrame, groups: Sequence[str], col: str, probs: Sequence[float],
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """-> one row per group: groups..., n, q_0 .. q_{k-1} (doubles)."""
    from tessera.operators.relate import maybe_broadcast
    from tessera.session import materialize

    groups = list(groups)
    probs = [float(p) for p in probs]
    k = len(probs)
    eps = 4.0 / accuracy
    src = df.where(F.col(col).isNotNull()).select(*groups, F.col(col).cast("double").alias("__v"))
    if not groups:
        src = src.withColumn("__g", F.lit(0))
        groups = ["__g"]
    ps = [max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs]
    stats = (src.groupBy(*groups)
                .agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ps, accuracy).alias("__b"),
                     F.min("__v").alias("__min"), F.max("__v").alias("__max")))
    big = F.col("__n") * F.lit(eps) >= 8
    stats = stats.select(
        *groups, "__n",
        *[F.when(big & (F.lit(ps[i]) > 0), F.col("__b")[i]).otherwise(F.col("__min")).alias(f"__lo{i}")
          for i in range(k)],
        *[F.when(big & (F.lit(ps[k + i]) < 1), F.col("__b")[k + i]).otherwise(F.col("__max")).alias(f"__hi{i}")
          for i in range(k)])
    stats = materialize(stats)                                        # one row per group, read twice
    j = src.join(maybe_broadcast(stats), groups)
    inside = F.lit(False)
    for i in range(k):
        inside = inside | ((F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__hi{i}")))
    counted = materialize(j.withColumn("__key", F.when(inside, F.col("__v")))
                .groupBy(*groups, "__key")
                .agg(F.count(F.lit(1)).alias("__c"),
                     *[F.sum((F.col("__v") < F.col(f"__lo{i}")).cast("long")).alias(f"__b{i}") for i in range(k)]))
    below = counted.groupBy(*groups).agg(*[F.sum(f"__b{i}").alias(f"__below{i}") for i in range(k)])
    band = counted.where(F.col("__key").isNotNull()).join(stats, groups).join(below, groups)
    rows = band.select(*groups, "__n", "__key", "__c", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pi"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi"),
                 F.col(f"__below{i}").alias("below")) for i in range(k)])).alias("__p"))
    rows = rows.where((F.col("__key") >= F.col("__p.lo")) & (F.col("__key") <= F.col("__p.hi")))
    w = Window.partitionBy(*groups, "__p.pi").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__cum", F.col("__p.below") + F.sum("__c").over(w))
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("__p.pi") + 1)
    h = prob * (F.col("__n") - 1)
    k1 = F.floor(h)
    k2 = F.least(k1 + 1, F.col("__n") - 1)
    pick = (rows.groupBy(*groups, "__n", F.col("__p.pi").alias("pi"))
                .agg(F.min(F.when(F.col("__cum") > k1, F.col("__key"))).alias("x1"),
                     F.min(F.when(F.col("__cum") > k2, F.col("__key"))).alias("x2"),
                     F.first(h).alias("h"), F.first(k1).alias("k1")))
    val = F.col("x1") + (F.col("h") - F.col("k1")) * (F.col("x2") - F.col("x1"))
    wide = (pick.groupBy(*groups, "__n")
                .agg(*[F.max(F.when(F.col("pi") == i, val)).alias(f"q_{i}") for i in range(k)]))
    out = wide.withColumnRenamed("__n", "n")
    return out.drop("__g") if groups == ["__g"] else out
