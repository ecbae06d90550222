"""Multi-class classification.

Linear SVM: one against one, as the reference library votes, all pairs of classes
trained side by side; Spark ML's ``OneVsRest(LinearSVC)`` is there too. RBF kernel, re-aimed: an
exact kernel SVM needs the n x n kernel matrix; instead a seeded random
Fourier feature map (Rahimi & Recht 2007) approximates the RBF kernel and the
same linear SVM is trained on the mapped features. The map is a matrix
product per Arrow batch (pandas UDF), the weights travel once per task in the
closure; its size is d x D, independent of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.session import materialize

FAN_IN = 32           # sums that meet in one task of a tree


def with_vector(df: DataFrame, col: str = "features", out: str = "vec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def rff_weights(dim: int, n_features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W ~ N(0, 2 gamma I), b ~ U(0, 2 pi) for k(x, y) = exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_features, dim))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    return w, b


def rff_column(col, w: np.ndarray, b: np.ndarray):
    """Column: sqrt(2/D) cos(W x + b) of an array column, one matmul per batch."""
    scale = math.sqrt(2.0 / w.shape[0])

    @F.pandas_udf(ArrayType(DoubleType()))
    def _map(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        x = np.vstack(s.to_numpy()).astype(float)
        z = scale * np.cos(x @ w.T + b)
        return pd.Series(list(z))

    return _map(F.col(col) if isinstance(col, str) else col)


def vector_length(df: DataFrame, col: str = "features") -> int:
    """Length of the (equally long) feature arrays; 0 for an empty table."""
    return df.agg(F.max(F.size(col))).first()[0] or 0


def width_gamma(df: DataFrame, col: str = "features") -> float:
    """Kernel width 1 / (mean squared distance) over all pairs of rows.

    The mean squared distance is twice the sum of the features' population
    variances, so one aggregate over all rows gives it.
    """
    from pyspark.ml.stat import Summarizer

    s = df.select(Summarizer.metrics("variance", "count").summary(
        array_to_vector(F.col(col).cast("array<double>"))).alias("s")).first()["s"]
    n = int(s["count"])
    mean = 2.0 * float(np.sum(s["variance"].toArray())) * (n - 1) / n if n > 1 else 0.0
    return 1.0 / mean if mean > 0 else 1.0


def centroids(df: DataFrame, features: str = "features", label: str = "digit") -> dict[int, list[float]]:
    """Mean feature vector of each class: classes x length numbers, summed on the cluster."""
    at = df.where(F.col(label).isNotNull()).select(F.col(label).alias("c"), F.posexplode(features).alias("i", "x"))
    out: dict[int, list[float]] = {}
    for r in at.groupBy("c", "i").agg(F.avg("x").alias("m")).orderBy("c", "i").collect():
        out.setdefault(r["c"], []).append(r["m"])
    return out


def nearest_centroid(means: dict[int, list[float]], features: str = "features"):
    """Column: the class whose mean vector is nearest (ties: the lowest class)."""
    apart = [F.struct(F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(float(x)) for x in m]), lambda a, b: (a - b) * (a - b)),
                                  F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(c).alias("c")) for c, m in sorted(means.items())]
    return F.array_min(F.array(*apart))["c"].cast("int") if apart else F.lit(None).cast("int")


class RandomFourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Transformer form of the RBF feature map, so the width can be a grid axis."""

    inputCol = Param(Params._dummy(), "inputCol", "array column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "map size", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "input length", TypeConverters.toInt)

    def __init__(self, inputCol="features", outputCol="rff", gamma=1.0, numFeatures=256, seed=7, dim=64):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="rff", gamma=1.0, numFeatures=256, seed=7, dim=64)
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, numFeatures=numFeatures, seed=seed, dim=dim)

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = rff_weights(self.getOrDefault(self.dim), self.getOrDefault(self.numFeatures),
                           self.getOrDefault(self.gamma), self.getOrDefault(self.seed))
        z = rff_column(self.getOrDefault(self.inputCol), w, b)
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(z))


def linear_svm(features: str = "vec", label: str = "label", max_iter: int = 50, reg: float = 0.0,
               parallelism: int = 10) -> OneVsRest:
    """One binary hinge-loss model per class, no standardisation (scale=FALSE).

    ``reg`` is 1 / (C n) for a cost C on n training rows (``svm_reg``).
    """
    svc = LinearSVC(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=reg,
                    standardization=False)
    return OneVsRest(classifier=svc, featuresCol=features, labelCol=label, parallelism=parallelism)


# ---- sums of gradients over all rows

def _compact(rows: DataFrame) -> DataFrame:
    """Rows that many steps read: written once, and dealt out to a task a core, since each task sends a sum."""
    return materialize(rows).coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def tree_sum(rows: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows: ``part`` of a record batch is an array of ``shape``. A task adds up its batches, and
    tasks' sums meet ``FAN_IN`` at a time until one is left, so that the driver gets one, however many tasks there are."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                out += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for b in batches:
            for g in b.column("g").to_pylist():
                out += np.frombuffer(g).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

    sums, width = rows.mapInArrow(first, "g binary"), max(1, rows.sparkSession.sparkContext.defaultParallelism)
    while width > 1:
        width = -(-width // FAN_IN)
        sums = sums.repartition(width).mapInArrow(add, "g binary")
    return sum((np.frombuffer(r["g"]).reshape(shape) for r in sums.collect()), np.zeros(shape))


def descend(gradient, shape: tuple[int, ...], curvature, steps: int, tol: float = 1e-7) -> np.ndarray:
    """Accelerated gradient steps from 0 of length 1 / ``curvature``, begun afresh where they turn back. Ends when no
    number moves by more than ``tol`` of the largest."""
    model = ahead = np.zeros(shape)
    turn = 1.0
    for _ in range(steps):
        slope = gradient(ahead)
        new = ahead - slope / curvature
        if float(np.sum(slope * (new - model))) > 0:
            turn = 1.0
        later = (1.0 + math.sqrt(1.0 + 4.0 * turn * turn)) / 2.0
        ahead = new + (turn - 1.0) / later * (new - model)
        moved, model, turn = float(np.abs(new - model).max()), new, later
        if moved <= tol * max(1.0, float(np.abs(model).max())):
            break
    return model


@dataclass
class PairwiseSvm:
    """A linear margin for each pair of classes: positive for the first of the two."""

    classes: np.ndarray
    weights: np.ndarray          # pairs x (features + 1), the constant last

    @property
    def pairs(self) -> list[tuple[int, int]]:
        k = len(self.classes)
        return [(i, j) for i in range(k) for j in range(i + 1, k)]

    def label(self, x: np.ndarray) -> np.ndarray:
        """The class with most pairs won; ties go to the larger sum of margins, then to the lower class."""
        margins = np.column_stack([x, np.ones(len(x))]) @ self.weights.T
        votes, total = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += margins[:, k] > 0
            votes[:, j] += margins[:, k] <= 0
            total[:, i] += margins[:, k]
            total[:, j] -= margins[:, k]
        best = votes == votes.max(axis=1, keepdims=True)
        return self.classes[np.where(best, total, -np.inf).argmax(axis=1)]

    def column(self, features: str | Column):
        """Column: the label of an array of features; none for a null."""
        @F.pandas_udf("int")
        def _label(s: pd.Series) -> pd.Series:
            out, have = pd.Series([None] * len(s), dtype="Int32"), s.notna().to_numpy()
            if have.any():
                out[have] = self.label(np.vstack(s[have].to_numpy()).astype(float))
            return out

        return _label(F.col(features) if isinstance(features, str) else features)


def one_against_one(train: DataFrame, c: float = 1.0, features: str = "features", label: str = "digit", steps: int = 200) -> PairwiseSvm:
    """Squared hinge loss with weight decay 1 / (C n) of the pair's n rows, for every pair of classes at once.

    A step is one pass over the rows; a row takes part in the pairs of its own class. Rows without a
    label or features are left out. One class alone has no pair and labels everything.
    """
    rows = train.select(F.col(label).cast("int").alias("y"), F.col(features).cast("array<double>").alias("x")).where("y IS NOT NULL AND x IS NOT NULL")
    data = _compact(rows)
    sizes = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).collect()}
    classes = np.array(sorted(sizes), int)
    model = PairwiseSvm(classes, np.zeros((0, 0)))
    dim = vector_length(data, "x")
    if not model.pairs:
        model.weights = np.zeros((0, dim + 1))
        return model
    first, second = (np.array([p[i] for p in model.pairs]) for i in (0, 1))
    n = np.array([sizes[classes[i]] + sizes[classes[j]] for i, j in model.pairs], float)
    decay = (1.0 / (c * n))[:, None]
    spark, shape = train.sparkSession, (len(first), dim + 1)

    def batch(b: pa.RecordBatch):
        x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1)
        y = np.searchsorted(classes, np.asarray(b.column("y")))[:, None]
        return np.column_stack([x, np.ones(len(x))]), (y == first).astype(float) - (y == second)     # rows x pairs: 1, -1 or not in it

    def squares(b: pa.RecordBatch) -> np.ndarray:
        z, _ = batch(b)
        return z.T @ z

    # The curvature of a pair's mean loss is at most twice the largest eigenvalue of all rows' products over its n.
    top = float(np.linalg.eigvalsh(tree_sum(data, squares, (dim + 1, dim + 1)))[-1])

    def gradient(w: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(w)

        def part(b: pa.RecordBatch) -> np.ndarray:
            z, sign = batch(b)
            slack = np.maximum(0.0, 1.0 - sign * (z @ sent.value.T)) * np.abs(sign)
            return -2.0 * (sign * slack).T @ z

        out = tree_sum(data, part, shape) / n[:, None] + decay * w
        sent.unpersist()
        return out

    model.weights = descend(gradient, shape, 2.0 * top / n[:, None] + decay, steps)
    return model


def svm_reg(train: DataFrame, c: float = 1.0) -> float:
    """The regularisation of cost C = ``c`` on these rows (the reference library's default cost is 1)."""
    return 1.0 / (c * max(1, train.count()))


def linear_label(vec, coefficients: np.ndarray, intercepts: np.ndarray):
    """Column: the class whose linear margin is largest (ties: the lowest), one matrix product a batch.
    A null vector has none."""
    weights, shifts = np.asarray(coefficients, float), np.asarray(intercepts, float)

    @F.pandas_udf("int")
    def _label(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype="Int32")
        have = s.notna().to_numpy()
        if have.any():
            out[have] = (np.vstack(s[have].to_numpy()) @ weights.T + shifts).argmax(axis=1)
        return out

    return _label(vector_to_array(F.col(vec) if isinstance(vec, str) else vec))


def fit_predict(train: DataFrame, test: DataFrame, estimator: OneVsRest, keep: list[str]) -> DataFrame:
    """Fit on the training part, label the test part.

    Only the fitted numbers travel to the tasks: a fitted model also holds its training
    summary, and through it the session.
    """
    models = estimator.fit(train).models
    label = linear_label(estimator.getFeaturesCol(), np.array([m.coefficients.toArray() for m in models]),
                         np.array([m.intercept for m in models]))
    return test.select(*keep, label.alias("prediction"))


def _mapped(x: np.ndarray, maps: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Random Fourier features of each width, with a constant last column."""
    return [np.column_stack([math.sqrt(2.0 / len(w)) * np.cos(x @ w.T + b), np.ones(len(x))]) for w, b in maps]


def grid_search(train: DataFrame, sigmas, cs, folds: int = 5, dim: int = 64, n_features: int = 256,
                label: str = "label", fold_col: str = "fold", iterations: int = 40, seed: int = 7) -> DataFrame:
    """C6 + C7: cross-validated accuracy over (sigma, C), one row per grid point.

    Every point, fold and class is a linear SVM (one against the rest, squared
    hinge loss, weight decay 1 / (C n)) on the width's random Fourier features. All
    of them are trained side by side by accelerated gradient steps: a step is one
    pass over the rows, in which a task a core adds up the gradients of its batches and
    the tasks' sums meet in a tree. A row takes part in the models of
    the other folds and is scored by those of its own. Rows without a label or with features of
    another length than ``dim`` are left out.
    """
    data = _compact(train.select(F.col(label).cast("int").alias("y"), F.col(fold_col).cast("int").alias("f"),
                                 F.col("features").cast("array<double>").alias("x")).where(F.col("y").isNotNull() & (F.size("x") == dim)))
    spark, n = train.sparkSession, data.count()
    classes = np.array(sorted(r["y"] for r in data.select("y").distinct().collect()))
    maps = [rff_weights(dim, n_features, float(s), seed) for s in sigmas]
    decay = np.array([1.0 / (float(c) * max(1, n)) for c in cs])
    shape = (len(maps), n_features + 1, len(cs), folds, len(classes))

    def batch(b: pa.RecordBatch):
        x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, dim)
        return _mapped(x, maps), np.asarray(b.column("y")), np.asarray(b.column("f"))

    def total(model: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(model)

        def part(b: pa.RecordBatch) -> np.ndarray:
            out, w = np.zeros(shape), sent.value
            zs, y, f = batch(b)
            sign = np.where(y[:, None] == classes[None, :], 1.0, -1.0)[:, None, None, :]
            use = (f[:, None] != np.arange(folds)[None, :])[:, None, :, None]
            for k, z in enumerate(zs):
                slack = np.maximum(0.0, 1.0 - sign * np.tensordot(z, w[k], 1)) * use
                out[k] -= 2.0 * np.tensordot(z.T, sign * slack, 1)
            return out

        out = tree_sum(data, part, shape)
        sent.unpersist()
        return out

    # The features have length 1 and the constant 1, so the smooth part's curvature is at most 4 plus the decay.
    model = ahead = np.zeros(shape)
    turn = 1.0
    for _ in range(iterations if n else 0):
        step = total(ahead) / n + decay[None, None, :, None, None] * ahead
        new = ahead - step / (4.0 + decay[None, None, :, None, None])
        later = (1.0 + math.sqrt(1.0 + 4.0 * turn * turn)) / 2.0
        ahead, model, turn = new + (turn - 1.0) / later * (new - model), new, later
    sent = spark.sparkContext.broadcast(model)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zs, y, f = batch(b)
            for k, z in enumerate(zs):
                own = np.einsum("nd,dcfk->nfck", z, sent.value[k])[np.arange(len(y)), f]
                right = classes[own.argmax(2)] == y[:, None]
                for c in range(len(cs)):
                    good, count = np.bincount(f, right[:, c], folds), np.bincount(f, minlength=folds)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * folds), pa.array([c] * folds), pa.array(range(folds)),
                                                      pa.array(good.astype(np.int64)), pa.array(count)],
                                                     names=["s", "c", "f", "good", "n"])

    found = data.mapInArrow(hits, "s long, c long, f long, good long, n long").groupBy("s", "c", "f") \
        .agg((F.sum("good") / F.sum("n")).alias("a")).where("a IS NOT NULL").groupBy("s", "c").agg(F.avg("a").alias("a")).collect() if n else []
    got = {(r["s"], r["c"]): r["a"] for r in found}
    rows = [(float(s), float(c), got.get((i, j), float("nan"))) for i, s in enumerate(sigmas) for j, c in enumerate(cs)]
    best = int(np.nanargmax([r[2] for r in rows])) if found else -1
    return spark.createDataFrame([(*r, i == best) for i, r in enumerate(rows)],
                                 "sigma double, c double, mean_accuracy double, is_best boolean")
