"""Cross-validation, grids, fit-and-predict and out-of-fold operators."""

from __future__ import annotations

import itertools
import random
import statistics
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles
from tessera.operators.sample import split, with_folds
from tessera.runtime import config

Scorer = Callable[[DataFrame, str, str], float]


def assemble(df: DataFrame, columns=None, output: str = "features") -> DataFrame:
    """Numerical columns as a vector; rows keep their nulls as NaN."""
    return VectorAssembler(inputCols=columns or roles.numericals(df), outputCol=output, handleInvalid="keep").transform(df)


def default_scorer(df: DataFrame, y: str) -> Scorer:
    """ROC AUC for binary targets, else R2."""
    binary = df.where(F.col(y).isNotNull()).agg(F.count_distinct(y)).first()[0] == 2
    if binary:
        return lambda d, label, _: BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction" if "rawPrediction" in d.columns else "prediction").evaluate(d)
    return lambda d, label, p: RegressionEvaluator(labelCol=label, predictionCol=p, metricName="r2").evaluate(d)


def do_cv(estimator: Estimator, df: DataFrame, y: str, key: str, n_iter: int = 3, scorer: Scorer | None = None, stratify: bool = False, seed: int = 0, parallel: int | None = None, custom: list[tuple[DataFrame, DataFrame]] | None = None) -> tuple[float, float]:
    """(mean, standard error) over n_iter shuffle splits that test a share of 1 / n_iter; fits run side by side.

    `custom` gives (train, test) pairs in place of the splits.
    """
    scorer = scorer or default_scorer(df, y)
    n_iter = len(custom) if custom else n_iter

    def one(i: int) -> float:
        train, test = custom[i] if custom else split(df, key, 1 - 1 / n_iter, seed + i, y if stratify else None)
        return scorer(estimator.fit(train).transform(test), y, "prediction")

    with ThreadPoolExecutor(parallel or config().parallel) as pool:
        scores = list(pool.map(one, range(n_iter)))
    return statistics.fmean(scores), statistics.stdev(scores) / len(scores) ** 0.5 if len(scores) > 1 else 0.0


def cv(df: DataFrame, estimator: Estimator, y: str, key: str, **options):
    """do_cv over the labelled rows' numerical columns."""
    return do_cv(estimator, assemble(df.where(F.col(y).isNotNull()), [c for c in roles.numericals(df) if c != y]), y, key, **options)


def cv_ohe(df: DataFrame, estimator: Estimator, y: str, key: str, **options):
    """cv after one-hot encoding the categorical-like columns."""
    from tessera.operators.encode import one_hot_vector

    ready = one_hot_vector(df.where(F.col(y).isNotNull()), [c for c in roles.categorical_like(df) if c not in (y, key)])
    return do_cv(estimator, ready, y, key, **options)


def do_gs(df: DataFrame, estimator: Estimator, y: str, key: str, grid: dict[str, list], random_iterations: int | None = None, seed: int = 0, **options) -> list[tuple[float, float, dict]]:
    """(score, error, parameters) of every point of the grid, or of some drawn at random; best first."""
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if random_iterations is not None:
        points = random.Random(seed).sample(points, min(random_iterations, len(points)))
    found = [(*do_cv(estimator.copy({estimator.getParam(k): v for k, v in p.items()}), df, y, key, seed=seed, **options), p) for p in points]
    return sorted(found, key=lambda x: -x[0] if config().higher_is_better else x[0])


def score_values(df: DataFrame, estimator: Estimator, y: str, key: str, param: str, values: list, **options):
    """do_gs over one parameter."""
    return do_gs(df, estimator, y, key, {param: values}, **options)


def coordinate_search(df: DataFrame, estimator: Estimator, y: str, key: str, grid: dict[str, list], **options) -> dict:
    """The best value of one parameter after another, the earlier ones kept."""
    best: dict = {}
    for name, values in grid.items():
        fixed = estimator.copy({estimator.getParam(k): v for k, v in best.items()})
        best[name] = score_values(df, fixed, y, key, name, values, **options)[0][2][name]
    return best


def score_operations(df: DataFrame, estimator: Estimator, y: str, key: str, columns: list[str], operations: dict[str, Callable[[DataFrame, str], DataFrame]], **options) -> dict[str, tuple[str | None, float]]:
    """For each column the operation that scores best, None if the column is best as it is."""
    out = {}
    for c in columns:
        scores = [(cv(df, estimator, y, key, **options)[0], None)] + [(cv(op(df, c), estimator, y, key, **options)[0], name) for name, op in operations.items()]
        best = max(scores, key=lambda s: s[0])
        out[c] = (best[1], best[0])
    return out


def fit_predict(df: DataFrame, estimator: Estimator, y: str, test: DataFrame | None = None) -> DataFrame:
    """Fit on the rows with a label; predict those of `test`, or without one the rows of df that have no label."""
    train = df.where(F.col(y).isNotNull())
    return estimator.fit(train).transform(df.where(F.col(y).isNull()) if test is None else test)


predict = fit_predict


def predict_proba(df: DataFrame, estimator: Estimator, y: str, test: DataFrame | None = None) -> DataFrame:
    """fit_predict with `proba`, an array of the classes' probabilities."""
    return fit_predict(df, estimator, y, test).withColumn("proba", vector_to_array("probability"))


def decision_function(df: DataFrame, estimator: Estimator, y: str, test: DataFrame | None = None) -> DataFrame:
    """fit_predict with `decision`, the raw score of the larger of two classes, an array of scores if there are more."""
    out = fit_predict(df, estimator, y, test).withColumn("decision", vector_to_array("rawPrediction"))
    n = df.where(F.col(y).isNotNull()).agg(F.count_distinct(y)).first()[0]
    return out.withColumn("decision", F.col("decision")[1]) if n == 2 else out


def transform(df: DataFrame, estimator: Estimator, y: str | None = None, test: DataFrame | None = None) -> DataFrame:
    """Fit on df, its labelled rows where there is a target, and transform `test`, or without one all of df."""
    train = df if y is None else df.where(F.col(y).isNotNull())
    return estimator.fit(train).transform(df if test is None else test)


def self_chunked_op(df: DataFrame, op: Callable[[DataFrame, DataFrame], DataFrame], key: str, k: int = 5, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """op(train, test) for each fold against the others; every row comes out once. Folds hold classes alike if stratified."""
    rows = with_folds(df, k, key, seed, "_fold", stratify)
    out = None
    for i in range(k):
        part = op(rows.where(F.col("_fold") != i).drop("_fold"), rows.where(F.col("_fold") == i).drop("_fold"))
        out = part if out is None else out.unionByName(part)
    return out


def self_predict(df: DataFrame, estimator: Estimator, key: str, k: int = 5, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """Out-of-fold predictions."""
    return self_chunked_op(df, lambda train, test: estimator.fit(train).transform(test), key, k, seed, stratify)


def self_predict_proba(df: DataFrame, estimator: Estimator, key: str, k: int = 5, seed: int = 0, stratify: str | None = None) -> DataFrame:
    return self_predict(df, estimator, key, k, seed, stratify).withColumn("proba", vector_to_array("probability"))


self_transform = self_predict


def restore_order(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def feature_importances(df: DataFrame, estimator: Estimator, columns: list[str]) -> list[tuple[str, float]]:
    """Importances of a fitted forest, or absolute coefficients, largest first."""
    model = estimator.fit(df)
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return sorted(zip(columns, map(abs, values.toArray().tolist())), key=lambda x: -x[1])


def feature_selection(df: DataFrame, estimator: Estimator, y: str, key: str, columns: list[str], mandatory=(), tolerance: float = 0.0, epochs: int | None = None, parallel: int = 4, validation: DataFrame | None = None, n_samples: int | None = None, top: int = 1, **options) -> list[str]:
    """Greedy forward selection by cross-validation, or by the score on a validation set.

    Of the `top` best columns of an epoch, that with the smallest error is taken; `n_samples` rows are drawn first.
    """
    from tessera.operators.sample import subsample

    chosen, best = list(mandatory), float("-inf")
    df = df if n_samples is None else subsample(df, n_samples, key, options.get("seed", 0))

    def score_of(c: str) -> tuple[float, float]:
        names = chosen + [c]
        own = options if validation is None else options | {"custom": [(assemble(df, names), assemble(validation, names))]}
        return do_cv(estimator, assemble(df, names), y, key, parallel=1, **own)

    for _ in range(epochs or len(columns)):
        left = [c for c in columns if c not in chosen]
        if not left:
            break
        with ThreadPoolExecutor(parallel) as pool:
            scores = list(pool.map(score_of, left))
        ranked = sorted(zip(scores, left), key=lambda x: (-x[0][0], x[0][1]))
        (score, _), c = min(ranked[:top], key=lambda x: (x[0][1], -x[0][0]))
        if score <= best + tolerance:
            break
        best, chosen = score, chosen + [c]
    return chosen


def default_estimators(label: str = "y", classify: bool = True) -> dict[str, Estimator]:
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    if classify:
        return {"logistic": C.LogisticRegression(labelCol=label), "tree": C.DecisionTreeClassifier(labelCol=label), "forest": C.RandomForestClassifier(labelCol=label, seed=0), "gbt": C.GBTClassifier(labelCol=label, seed=0), "svc": C.LinearSVC(labelCol=label), "bayes": C.NaiveBayes(labelCol=label, modelType="gaussian")}
    return {"linear": R.LinearRegression(labelCol=label), "tree": R.DecisionTreeRegressor(labelCol=label), "forest": R.RandomForestRegressor(labelCol=label, seed=0), "gbt": R.GBTRegressor(labelCol=label, seed=0)}


def try_all(df: DataFrame, y: str, key: str, classify: bool = True, **options) -> list[tuple[str, float, float, str | None]]:
    """(name, score, error, None) of every estimator of the list, best first; those that fail last, with NaN and the message."""
    found, failed = [], []
    for name, e in default_estimators(y, classify).items():
        try:
            found.append((name, *do_cv(e, df, y, key, **options), None))
        except Exception as why:  # noqa: BLE001  an estimator that these data do not suit
            failed.append((name, float("nan"), float("nan"), str(why).splitlines()[0]))
    return sorted(found, key=lambda x: -x[1]) + failed


def explain_params(estimator: Estimator) -> dict[str, str]:
    return {p.name: p.doc for p in estimator.params}
