"""Classification metrics.

The confusion counts are one grouped aggregate over the predictions; every
ratio is derived from those k x k counts. Exact binomial intervals and the
accuracy-versus-no-information test need only three numbers, so they are
evaluated on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.regress import betainc
from tessera.session import materialize


def confusion(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """C4: counts per (actual, predicted) pair."""
    return (pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
                .agg(F.count(F.lit(1)).alias("n")))


def class_metrics(conf: DataFrame) -> DataFrame:
    """C5 ratios per class: sensitivity, specificity, prevalence; plus overall
    accuracy, no-information rate and Cohen's kappa on every row.

    The per-class totals are small aggregates of the confusion table (k^2 rows).
    """
    conf = materialize(conf)                                          # k x k counts, read four times
    classes = (conf.select(F.col("actual").alias("cls")).union(conf.select(F.col("predicted").alias("cls")))
                   .distinct())
    act = conf.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("n_actual"))
    prd = conf.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    tp = conf.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    per = (classes.join(act, "cls", "left").join(prd, "cls", "left").join(tp, "cls", "left")
                  .fillna(0, ["n_actual", "n_pred", "tp"]))
    g = per.agg(F.sum("n_actual").alias("N"), F.sum("tp").alias("correct"),
                F.sum(F.col("n_actual") * F.col("n_pred")).alias("pp"), F.max("n_actual").alias("mx")).first()
    N = int(g["N"] or 0)
    if N == 0:
        return per.select("cls", *[F.lit(None).cast("double").alias(c) for c in
                                   ["sensitivity", "specificity", "prevalence", "accuracy", "nir", "kappa"]],
                          F.lit(0).cast("long").alias("n"))
    pe, nir = float(g["pp"]) / (N * N), float(g["mx"]) / N
    per = per.withColumns({"N": F.lit(N).cast("long"), "correct": F.lit(int(g["correct"])).cast("long"),
                           "pe": F.lit(pe), "nir": F.lit(nir)})
    acc = F.col("correct") / F.col("N")
    return per.select(
        "cls",
        F.try_divide(F.col("tp"), F.col("n_actual")).alias("sensitivity"),
        F.try_divide(F.col("N") - F.col("n_actual") - F.col("n_pred") + F.col("tp"), F.col("N") - F.col("n_actual"))
        .alias("specificity"),
        (F.col("n_actual") / F.col("N")).alias("prevalence"),
        acc.alias("accuracy"), F.col("nir"),
        F.try_divide(acc - F.col("pe"), F.lit(1.0) - F.col("pe")).alias("kappa"),
        F.col("N").alias("n"))


def _beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if betainc(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def exact_interval(x: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval for x successes in n trials."""
    a = (1.0 - level) / 2.0
    lo = 0.0 if x == 0 else _beta_quantile(a, x, n - x + 1)
    hi = 1.0 if x == n else _beta_quantile(1.0 - a, x + 1, n - x)
    return lo, hi


def p_greater(x: int, n: int, p0: float) -> float:
    """One-sided binomial test P[X >= x | n, p0] (accuracy above the NIR)."""
    if x <= 0:
        return 1.0
    return betainc(float(x), float(n - x + 1), p0)


def summary_row(correct: int, n: int, nir: float, kappa: float) -> dict:
    lo, hi = exact_interval(correct, n)
    return {"accuracy": correct / n if n else float("nan"), "ci_low": lo, "ci_high": hi, "nir": nir,
            "p_acc_gt_nir": p_greater(correct, n, nir), "kappa": kappa, "n": n}
