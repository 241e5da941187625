"""Linear and logistic regression, lowered from the built-in learners to a coefficient table.

Least squares over folds needs the rows once: sums of products per fold are
all that a fit reads, and the sums of a fold's training rows are those of the
other folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from glasswork.functions.sqltext import ident, number
from glasswork.models import LinearModel
from glasswork.operators.additive import target_classes
from glasswork.sources.session import importable

# Rows whose means the products are taken around; any near value keeps the sums accurate, and none changes a result.
SHIFT_ROWS = 1_000
# A fold's matrix of products has the square of so many cells at most; wider tables are fitted fold by fold.
FOLD_FEATURES = 512


def assembled(df: DataFrame, features, label, nulls: str = "error") -> DataFrame:
    """Vector and label columns of the rows with a label.

    A linear score of a row with a null feature is null, so such a row cannot be
    fitted: ``nulls`` says whether that is an error that tells their number, or
    they are dropped.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], label.alias("_label")).dropna(subset=["_label"])
    if nulls not in ("error", "drop"):
        raise ValueError("nulls is 'error' or 'drop'")
    if nulls == "error":
        holes = null_feature_rows(rows, features)
        if holes:
            raise ValueError(f"{holes} rows have a null feature; fill them, or pass nulls='drop'")
    rows = rows.dropna()
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows).select("_features", "_label")


def null_feature_rows(df: DataFrame, features) -> int:
    """How many rows have a null in any of the features."""
    if not features:
        return 0
    return df.agg(F.count_if(F.greatest(*[F.col(f).isNull().cast("int") for f in features], F.lit(0)) == 1)).first()[0]


def fit_linear(df: DataFrame, target: str, features, name: str = "l_regression", alpha: float = 1.0,
               l1_ratio: float = 1.0, solver: str = "normal", nulls: str = "error") -> LinearModel:
    """Least squares with an L1 penalty by default; ``alpha=0`` is plain least squares.

    The normal-equation solver reads the rows once, whatever the penalty; it
    takes up to 4,096 features, ``solver="l-bfgs"`` any number.
    """
    features = tuple(features)
    learner = LinearRegression(featuresCol="_features", labelCol="_label", regParam=alpha, elasticNetParam=l1_ratio,
                               standardization=False, solver=solver)
    fit = learner.fit(assembled(df, features, F.col(target).cast("double"), nulls))
    return LinearModel(name, "regression", target, features, (float(fit.intercept),),
                       (tuple(float(c) for c in fit.coefficients),))


def fold_products(df: DataFrame, target: str, features, fold: str = "fold") -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(shift, per fold the sums of products of (1, features, target)) around ``shift``, from one scan.

    Rows with a null among them or without a fold are left out. A task adds up
    its rows by matrix products, Spark adds the cells of all tasks.
    """
    importable(df.sparkSession)
    names = [*features, target]
    rows = df.select(F.col(fold).cast("long").alias("_fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    first = rows.limit(SHIFT_ROWS).agg(*[F.avg(f"x{i}") for i in range(len(names))]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])
    size = len(names) + 1
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = batch["_fold"].to_numpy()
            z = np.column_stack([np.ones(len(folds)), *[batch[f"x{i}"].to_numpy() - m for i, m in enumerate(shift)]])
            for k in np.unique(folds):
                part = z[folds == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        for k, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k)), pa.array(np.arange(len(upper[0]))), pa.array(g[upper])],
                                             names=["fold", "cell", "v"])

    cells = rows.mapInArrow(add, "fold long, cell long, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow()
    out: dict[int, np.ndarray] = {}
    folds, places, values = (cells[c].to_numpy() for c in ("fold", "cell", "v"))
    for k in np.unique(folds):
        g, own = np.zeros((size, size)), folds == k
        g[upper[0][places[own]], upper[1][places[own]]] = values[own]
        out[int(k)] = g + np.triu(g, 1).T
    return shift, out


def solve_products(shift: np.ndarray, products: np.ndarray, alpha: float, l1_ratio: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the penalised least squares problem that the sums describe."""
    n = products[0, 0]
    if n <= 0:
        return 0.0, np.zeros(len(shift) - 1)
    mean = products[0, 1:] / n
    cov = products[1:, 1:] / n - np.outer(mean, mean)
    s, c = cov[:-1, :-1], cov[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(s), 0.0))
    live = scale > 1e-9 * np.maximum(np.abs(shift[:-1]), 1e-300)
    b = np.zeros(len(c))
    if alpha == 0 and live.any():
        unit = scale[live]
        b[live] = np.linalg.lstsq(s[np.ix_(live, live)] / np.outer(unit, unit), c[live] / unit, rcond=1e-12)[0] / unit
    elif live.any():
        left = c.copy()
        for _ in range(100_000):
            moved = 0.0
            for j in np.flatnonzero(live):
                rest = left[j] + s[j, j] * b[j]
                new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / (s[j, j] + alpha * (1.0 - l1_ratio))
                if new != b[j]:
                    left -= s[:, j] * (new - b[j])
                    moved = max(moved, abs(new - b[j]) * scale[j])
                    b[j] = new
            if moved <= 1e-12 * np.sqrt(max(cov[-1, -1], 1e-300)):
                break
    centre = shift + mean
    return float(centre[-1] - centre[:-1] @ b), b


def cross_fit_linear(folded: DataFrame, target: str, features, fold: str = "fold", alpha: float = 1.0, l1_ratio: float = 1.0,
                     time_series: bool = False, name: str = "l_regression") -> tuple[LinearModel, DataFrame]:
    """(model of all folds, out-of-fold predictions) from two scans, whatever the number of folds.

    Half the mean squared error plus ``alpha * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2)`` is least; the
    built-in learner of ``fit_linear`` divides the second part by the target's deviation.

    Each fold is predicted by the model of the other folds, with
    ``time_series`` of the folds before it (the first one is not predicted).
    Rows with a null feature are not learned from and get a null prediction;
    rows without a fold are neither.
    """
    features = tuple(features)
    shift, products = fold_products(folded, target, features, fold)
    empty = np.zeros((len(features) + 2,) * 2)

    def fitted(folds) -> tuple[float, np.ndarray]:
        return solve_products(shift, reduce(np.add, [products[k] for k in folds], empty), alpha, l1_ratio)

    def text(intercept: float, b: np.ndarray) -> str:
        return " + ".join([number(intercept), *[f"{number(v)} * {ident(f)}" for f, v in zip(features, b)]])

    numbers = sorted(products)
    tested = numbers[1:] if time_series else numbers
    whens = [f"WHEN {k} THEN {text(*fitted([o for o in numbers if (o < k if time_series else o != k)]))}" for k in tested]
    intercept, b = fitted(numbers)
    model = LinearModel(name, "regression", target, features, (intercept,), (tuple(b.tolist()),))
    rows = folded.filter(F.col(fold).isin(tested)) if tested else folded.limit(0)
    prediction = f"CASE {ident(fold)} {' '.join(whens)} END" if whens else "cast(null AS double)"
    return model, rows.withColumn("prediction", F.expr(prediction))


def class_index(target: str, classes):
    out = F.when(F.col(target) == F.lit(classes[0]), 0.0)
    for i, c in enumerate(classes[1:], 1):
        out = out.when(F.col(target) == F.lit(c), float(i))
    return out


def fit_logistic(df: DataFrame, target: str, features, name: str = "l_regression", C: float = 1.0,
                 max_iter: int = 100, classes: tuple = (), nulls: str = "error") -> LinearModel:
    """Binary or multinomial logistic regression with an L2 penalty of strength 1 / (C * rows)."""
    features = tuple(features)
    classes = classes or target_classes(df, target)
    rows = assembled(df, features, class_index(target, classes), nulls)
    penalty = 1.0 / (C * max(rows.count(), 1))
    binary = len(classes) == 2
    fit = LogisticRegression(
        featuresCol="_features", labelCol="_label", regParam=penalty, elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, family="binomial" if binary else "multinomial").fit(rows)
    coefs = [tuple(map(float, row)) for row in fit.coefficientMatrix.toArray()]
    intercept = tuple(map(float, fit.interceptVector))
    return LinearModel(name, "binary" if binary else "multiclass", target, features, intercept, tuple(coefs), classes)
