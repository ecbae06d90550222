"""Digit classification workload: profile, sample, split into folds, train a
linear and an RBF-approximating SVM, tune over a grid, score with a confusion
matrix and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import rnd
from tessera.operators.classify import (
    centroids, grid_search, nearest_centroid, one_against_one, rff_column, rff_weights, vector_length, width_gamma, with_vector,
)
from tessera.operators.metrics import class_metrics, confusion, summary_row
from tessera.operators.profile import column_summary
from tessera.operators.relate import param_grid
from tessera.operators.sample import FOLD_SALT, SAMPLE_SALT, balanced_folds, exact_flag, hash_unit_sql, split_flag
from tessera.plans import bind
from tessera.session import materialize

TRAIN_FRACTION = 0.7
SAMPLE_FRACTION = 1.0 / 30.0
FOLDS = 5
# Five widths around the one that the data suggest, and the costs of the search.
GRID_SIGMA_FACTORS = [0.25, 0.5, 1.0, 2.0, 4.0]
GRID_C = [1.0, 2.0, 3.0, 4.0, 5.0]
RFF_FEATURES = 256
SEED = 7


# ------------------------------------------------------------------ operators
def pixels(features: str = "features"):
    """Integer intensities 0..255 from features in [-0.5, 0.5) (floor, clamped)."""
    return F.transform(F.col(features), lambda x: F.least(F.greatest(F.floor((x + 0.5) * 256), F.lit(0)),
                                                          F.lit(255)).cast("int"))


def pixel_columns(df: DataFrame, dim: int) -> DataFrame:
    return df.select("image_id", *[F.get(pixels(), i).alias(f"px{i}") for i in range(dim)])


def _prepared(spark, sf_dir):
    v = bind.digits_view(spark, sf_dir)
    return with_vector(v.withColumn("label", F.col("digit").cast("double"))
                        .withColumn("is_train", split_flag("image_id", TRAIN_FRACTION)))


def _metrics_frame(spark, pred: DataFrame, model: str) -> DataFrame:
    cm = class_metrics(confusion(pred, "digit", "prediction"))
    head = cm.select("accuracy", "nir", "kappa", "n").first()
    if head is None:
        return spark.createDataFrame([], "model string, accuracy double, ci_low double, ci_high double, "
                                         "nir double, p_acc_gt_nir double, kappa double, n long")
    correct = int(round(head["accuracy"] * head["n"]))
    s = summary_row(correct, int(head["n"]), float(head["nir"]), float(head["kappa"]))
    return spark.createDataFrame([(model, s["accuracy"], s["ci_low"], s["ci_high"], s["nir"], s["p_acc_gt_nir"],
                                   s["kappa"], s["n"])],
                                 "model string, accuracy double, ci_low double, ci_high double, nir double, "
                                 "p_acc_gt_nir double, kappa double, n long")


# ------------------------------------------------------------------ bindings
def q_column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bind.digits_view(spark, sf_dir)
    dim = vector_length(v)
    s = column_summary(pixel_columns(v, dim), [f"px{i}" for i in range(dim)], exact=True)
    return s.select("column_name", "min", rnd("q1", 6).alias("q1"), rnd("median", 6).alias("median"),
                    rnd("mean", 6).alias("mean"), rnd("q3", 6).alias("q3"), "max")


def q_stratified_sample(spark, sf_dir):
    """M2: exactly trunc(n / 30) rows of every digit class, those of least key hash."""
    v = bind.digits_view(spark, sf_dir).where("digit IS NOT NULL").select("image_id", "digit")
    return exact_flag(v, "image_id", SAMPLE_FRACTION, "digit", SAMPLE_SALT, "taken").where("taken").drop("taken")


def q_cv_folds(spark, sf_dir):
    """M3: the fold of every training row, dealt out evenly inside each class."""
    return _train(spark, sf_dir).select("image_id", "fold")


def _train(spark, sf_dir):
    return balanced_folds(bind.digits_view(spark, sf_dir).where(split_flag("image_id", TRAIN_FRACTION)), "image_id", "digit", FOLDS)


def q_param_grid(spark, sf_dir):
    """(sigma factor x C x fold) grid with the training and validation row
    counts each point uses."""
    d = _train(spark, sf_dir)
    n = d.count()
    per = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n_valid")) \
        .select("fold", (F.lit(n) - F.col("n_valid")).alias("n_train"), "n_valid")
    grid = param_grid(spark, sigma_factor=GRID_SIGMA_FACTORS, c=GRID_C, fold=list(range(FOLDS))) \
        .withColumn("fold", F.col("fold").cast("int"))
    return grid.join(F.broadcast(per), "fold").select("sigma_factor", "c", "fold", "n_train", "n_valid")


def q_confusion_matrix(spark, sf_dir):
    """C4: confusion counts of a nearest-centroid classifier over all features, learned
    from the training rows and applied to all."""
    return confusion(_by_centroid(spark, sf_dir), "digit", "prediction")


def _by_centroid(spark, sf_dir):
    v = bind.digits_view(spark, sf_dir)
    return v.withColumn("prediction", nearest_centroid(centroids(v.where(split_flag("image_id", TRAIN_FRACTION)))))


def q_class_metrics(spark, sf_dir):
    """Per-class sensitivity, specificity, prevalence and overall accuracy,
    no-information rate and kappa of the nearest-centroid classifier's confusion counts."""
    m = class_metrics(confusion(_by_centroid(spark, sf_dir), "digit", "prediction"))
    return m.select(F.col("cls").alias("class"), *[rnd(c, 6).alias(c) for c in
                    ["sensitivity", "specificity", "prevalence", "accuracy", "nir", "kappa"]], "n")


def q_svm_linear(spark, sf_dir):
    """C1 + C3 + C5: one-against-one linear SVM on the unscaled features, scored on the
    holdout: accuracy, exact 95% interval, no-information rate and test, kappa."""
    d = _prepared(spark, sf_dir)
    model = one_against_one(d.where("is_train"))
    return _metrics_frame(spark, d.where("not is_train").select("digit", model.column("features").alias("prediction")), "linear")


def q_svm_rbf(spark, sf_dir):
    """C2 + C3 + C5: the same, on random Fourier features approximating an RBF
    kernel whose width comes from the mean squared distance of all training rows."""
    d = _prepared(spark, sf_dir)
    tr = d.where("is_train")
    w, b = rff_weights(vector_length(tr), RFF_FEATURES, width_gamma(tr), SEED)
    mapped = d.withColumn("rff", rff_column("features", w, b))
    model = one_against_one(mapped.where("is_train"), features="rff")
    return _metrics_frame(spark, mapped.where("not is_train").select("digit", model.column("rff").alias("prediction")), "rbf_rff")


def q_svm_grid(spark, sf_dir):
    """C6 + C7: cross-validated accuracy of the RBF-approximating SVM over a
    (width x C) grid, with the best point flagged."""
    d = _prepared(spark, sf_dir)
    tr = materialize(balanced_folds(d.where("is_train"), "image_id", "digit", FOLDS).select("label", "fold", "features"))
    gamma = width_gamma(tr)
    return grid_search(tr, [gamma * f for f in GRID_SIGMA_FACTORS], GRID_C, FOLDS, vector_length(tr), RFF_FEATURES)


QUERIES = {
    "column_summary": q_column_summary,
    "stratified_sample": q_stratified_sample,
    "cv_folds": q_cv_folds,
    "param_grid": q_param_grid,
    "confusion_matrix": q_confusion_matrix,
    "class_metrics": q_class_metrics,
    "svm_linear": q_svm_linear,
    "svm_rbf": q_svm_rbf,
    "svm_grid": q_svm_grid,
}

# ------------------------------------------------------------------ oracles
_PX = "CAST(least(greatest(floor((CAST(x AS DOUBLE) + 0.5) * 256), 0), 255) AS INTEGER)"
_FOLD = f"CAST((row_number() OVER (PARTITION BY label ORDER BY {hash_unit_sql('vec_id', FOLD_SALT)}, vec_id) - 1) % {FOLDS} AS INTEGER)"
_TRAIN = f"{hash_unit_sql('vec_id')} < {TRAIN_FRACTION}"
_CONF = f"""SELECT actual, predicted, count(*) AS n FROM (
  SELECT label AS actual, arg_min(c, struct_pack(d := d, c := c)) AS predicted FROM (
    SELECT vec_id, label, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM
      (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
      (SELECT c, list(m ORDER BY i) AS m FROM (
        SELECT label AS c, i, avg(v) AS m FROM (
          SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i
          FROM embeddings WHERE label IS NOT NULL AND {_TRAIN}) GROUP BY ALL) GROUP BY c))
  GROUP BY vec_id, label) GROUP BY ALL"""

ORACLES = {
    "column_summary": f"""WITH px AS (
  SELECT 'px' || CAST(i - 1 AS VARCHAR) AS column_name, CAST(v AS DOUBLE) AS v FROM (
    SELECT unnest(list_transform(embedding, lambda x: {_PX})) AS v, unnest(range(1, len(embedding) + 1)) AS i
    FROM embeddings))
SELECT column_name, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max FROM px GROUP BY column_name""",
    "stratified_sample": f"""SELECT vec_id AS image_id, label AS digit FROM embeddings WHERE label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {hash_unit_sql('vec_id', SAMPLE_SALT)}, vec_id)
  <= floor({SAMPLE_FRACTION}::DOUBLE * count(*) OVER (PARTITION BY label))""",
    "cv_folds": f"SELECT vec_id AS image_id, {_FOLD} AS fold FROM embeddings WHERE {_TRAIN}",
    "param_grid": f"""WITH f AS (SELECT fold, count(*) AS n_valid FROM (SELECT {_FOLD} AS fold FROM embeddings WHERE {_TRAIN}) GROUP BY 1),
t AS (SELECT count(*) AS n FROM embeddings WHERE {_TRAIN})
SELECT s.sigma_factor, c.c, f.fold, t.n - f.n_valid AS n_train, f.n_valid
FROM (SELECT unnest([{', '.join(str(x) for x in GRID_SIGMA_FACTORS)}])::DOUBLE AS sigma_factor) s,
     (SELECT unnest([{', '.join(str(x) for x in GRID_C)}])::DOUBLE AS c) c, f, t""",
    "confusion_matrix": _CONF,
    "class_metrics": f"""WITH cm AS ({_CONF}),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm),
tot AS (SELECT sum(n) AS N, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS correct FROM cm),
a AS (SELECT actual AS c, sum(n) AS n_actual FROM cm GROUP BY 1),
p AS (SELECT predicted AS c, sum(n) AS n_pred FROM cm GROUP BY 1),
tp AS (SELECT actual AS c, n AS tp FROM cm WHERE actual = predicted),
per AS (SELECT cls.c, coalesce(n_actual, 0) AS n_actual, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, N, correct
        FROM cls LEFT JOIN a ON cls.c = a.c LEFT JOIN p ON cls.c = p.c LEFT JOIN tp ON cls.c = tp.c, tot),
g AS (SELECT sum(n_actual * n_pred) / (any_value(N) * any_value(N)) AS pe, max(n_actual) / any_value(N) AS nir FROM per)
SELECT c AS class, round(tp / n_actual, 6) AS sensitivity, round((N - n_actual - n_pred + tp) / (N - n_actual), 6) AS specificity,
  round(n_actual / N, 6) AS prevalence, round(correct / N, 6) AS accuracy, round(nir, 6) AS nir,
  round((correct / N - pe) / (1.0 - pe), 6) AS kappa, CAST(N AS BIGINT) AS n FROM per, g""",
}
