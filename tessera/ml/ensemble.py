"""Ensembles of prediction columns, and wrappers that change targets or predictions around a fit."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import YTransform, sigmoid
from tessera.operators.clean import floor_at, trim_on_y

#: Of target and prediction, and of the names picked so far where a scorer takes three.
Score = Callable[..., Column]


def neg_mse(y: Column, p: Column) -> Column:
    return -F.avg((y - p) * (y - p))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == F.when(p > 0.5, 1).otherwise(0)).cast("double"))


def greedy_ensemble(df: DataFrame, y: str, columns: list[str], score: Score = neg_mse, epochs: int = 10, max_replacements: int = 0, start: list[str] = (), early_exit: bool = False, chooser: Callable[[list[tuple[float, str]]], tuple[float, str]] = max) -> list[tuple[str, float]]:
    """(column, score of the mean so far) picked one after another, each at most max_replacements + 1 times.

    Every epoch scores all candidates in one aggregation. A score that takes three arguments is given the picks that
    it scores. `start` are picks of before, their scores worked out again, all in one aggregation.
    """
    def scored(names: list[str]) -> Column:
        more = (names,) if len(inspect.signature(score).parameters) > 2 else ()
        return score(F.col(y), ensemble_column(names), *more)

    picks: list[tuple[str, float]] = []
    if start:
        picks = list(zip(start, df.agg(*[scored(list(start[: i + 1])).alias(f"s{i}") for i in range(len(start))]).first()))
    for _ in range(epochs):
        used = [c for c, _ in picks]
        left = [c for c in columns if used.count(c) <= max_replacements]
        if not left:
            break
        row = df.agg(*[scored([*used, c]).alias(f"s{i}") for i, c in enumerate(left)]).first()
        value, best = chooser(list(zip(row, left)))
        if early_exit and picks and value <= picks[-1][1]:
            break
        picks.append((best, value))
    return picks


def best_prefix(picks: list[tuple[str, float]]) -> list[str]:
    """The picks up to the best score."""
    at = max(range(len(picks)), key=lambda i: (not math.isnan(picks[i][1]), picks[i][1]))
    return [c for c, _ in picks[: at + 1]]


def ensemble_column(picks: list[str]) -> Column:
    return sum((F.col(c) for c in picks[1:]), F.col(picks[0])) / len(picks)


def optimise_weights(df: DataFrame, y: str, columns: list[str], rounds: int = 200, positive: bool = True) -> dict[str, float]:
    """Weights that sum to 1 and make the mean's squared error least, from one aggregation of cross moments.

    Projected gradient steps on the moments; the data are not read again.
    """
    import numpy as np

    k = len(columns)
    aggs = [F.avg(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]] + [F.avg(F.col(c) * F.col(y)) for c in columns]
    row = list(df.agg(*[a.alias(f"m{i}") for i, a in enumerate(aggs)]).first())
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[at]
            at += 1
    cross, w = np.array(row[at:]), np.full(k, 1 / k)
    step = 1 / max(np.linalg.eigvalsh(gram).max(), 1e-12)
    for _ in range(rounds):
        w = w - step * (gram @ w - cross)
        if positive:
            s = np.sort(w)[::-1]
            t = (np.cumsum(s) - 1) / np.arange(1, k + 1)
            w = np.maximum(w - t[np.flatnonzero(s > t)[-1]], 0)
        else:
            w = w + (1 - w.sum()) / k
    return dict(zip(columns, w.tolist()))


def optimise_any(df: DataFrame, y: str, columns: list[str], score: Score, rounds: int = 3, grid: int = 11) -> dict[str, float]:
    """Weights by coordinate search for any score; each line search is one aggregation."""
    w = {c: 0.5 for c in columns}
    for _ in range(rounds):
        for c in columns:
            tries = [i / (grid - 1) for i in range(grid)]
            mean = lambda v: sum((F.col(d) * (v if d == c else w[d]) for d in columns), F.lit(0.0)) / max(sum(v if d == c else w[d] for d in columns), 1e-9)
            row = df.agg(*[score(F.col(y), mean(v)).alias(f"s{i}") for i, v in enumerate(tries)]).first()
            w[c] = max(zip(row, tries))[1]
    total = sum(w.values()) or 1
    return {c: v / total for c, v in w.items()}


def calibrate_out_of_fold(df: DataFrame, y: str, columns: list[str] | str, key: str, method: str = "sigmoid", k: int = 5, seed: int = 0, suffix: str = "_calibrated") -> DataFrame:
    """Each score column calibrated as <c><suffix>: labelled rows by a fit on the other folds (stratified), others by a fit on all.

    A row's own label has no part in its calibrated score.
    """
    from tessera.ml.folds import self_chunked_op

    names = [columns] if isinstance(columns, str) else list(columns)
    known, rest = df.where(F.col(y).isNotNull()), df.where(F.col(y).isNull())

    def apply(train: DataFrame, test: DataFrame) -> DataFrame:
        for c in names:
            test = _calibrator(train, y, c, method)(test, c + suffix)
        return test

    return self_chunked_op(known, apply, key, k, seed, y).unionByName(apply(known, rest))


def calibrate(df: DataFrame, y: str, p: str, method: str = "sigmoid", output: str = "calibrated") -> DataFrame:
    """Platt scaling ('sigmoid') or isotonic regression of a score, fitted on the labelled rows, applied to all.

    Labelled rows so take part in their own score; `calibrate_out_of_fold` keeps them out.
    """
    return _calibrator(df, y, p, method)(df, output)


def _calibrator(df: DataFrame, y: str, p: str, method: str) -> Callable[[DataFrame, str], DataFrame]:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    train = df.where(F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double"))
    if method == "isotonic":
        steps = IsotonicRegression(featuresCol=p, labelCol="_y", predictionCol="_c").fit(train)
        return lambda rows, output: steps.transform(rows).withColumnRenamed("_c", output)
    ready = VectorAssembler(inputCols=[p], outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(ready.transform(train))
    return lambda rows, output: model.transform(ready.transform(rows)).withColumn(output, vector_to_array("_p")[1]).drop("_x", "_p", "_c", "_r")


def probability_of(df: DataFrame, mode: str = "sigmoid", raw: str = "rawPrediction", output: str = "proba") -> DataFrame:
    """The raw score of the positive class as a probability: by sigmoid, or min-max."""
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array(raw)[1]
    if mode == "sigmoid":
        return df.withColumn(output, sigmoid(score))
    df = df.withColumn("_s", score)
    low, high = df.agg(F.min("_s"), F.max("_s")).first()
    return df.withColumn(output, F.try_divide(F.col("_s") - F.lit(low), F.lit(high) - F.lit(low))).drop("_s")


class Wrapped:
    """An estimator whose training rows, target or predictions are changed around the fit."""

    def __init__(self, estimator: Estimator, y: str, op=None, min_y=None, max_y=None, floor=None):
        self.estimator, self.y, self.op, self.bounds, self.floor = estimator, y, op, (min_y, max_y), floor

    def fit(self, df: DataFrame) -> Wrapped:
        df = trim_on_y(df.where(F.col(self.y).isNotNull()), self.y, *self.bounds)
        if self.op is not None:
            self.transformer = self.op if isinstance(self.op, YTransform) else YTransform.fit(df, self.y, self.op)
            df = df.withColumn(self.y, self.transformer.apply(F.col(self.y)))
        self.model = self.estimator.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if self.op is not None:
            out = out.withColumn("prediction", self.transformer.invert(F.col("prediction")))
        return out if self.floor is None else floor_at(out, "prediction", self.floor)


def transform_y(estimator, y, op):
    return Wrapped(estimator, y, op)


def trim_on_y_fit(estimator, y, min_y=None, max_y=None):
    return Wrapped(estimator, y, min_y=min_y, max_y=max_y)


def min_y_value(estimator, y, least):
    return Wrapped(estimator, y, floor=least)


class SplitModels:
    """A model per value of a split column; -1 is for a fallback that was fitted before.

    Rows whose value is null or has no model get the fallback's predictions, without one nulls; no row is left out.
    """

    def __init__(self, estimators: list[Estimator], index: Column, fallback=None):
        self.estimators, self.index, self.fallback = estimators, index, fallback

    def fit(self, df: DataFrame) -> SplitModels:
        rows = df.withColumn("_i", self.index)
        ids = sorted(r[0] for r in rows.select("_i").distinct().collect() if r[0] != -1)
        if len(ids) != len(self.estimators):
            raise ValueError(f"{len(ids)} splits for {len(self.estimators)} estimators")
        self.models = {i: e.fit(rows.where(F.col("_i") == i).drop("_i")) for i, e in zip(ids, self.estimators)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows, out = df.withColumn("_i", self.index), None
        for i, model in self.models.items():
            part = model.transform(rows.where(F.col("_i") == i).drop("_i"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        other = rows.where(F.col("_i").isNull() | ~F.col("_i").isin(*self.models)).drop("_i")
        return out.unionByName(other if self.fallback is None else self.fallback.transform(other), allowMissingColumns=True)
