"""Operators that no query shows: shapes and properties of their results."""

import logging

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera import roles, runtime
from tessera.ml import ensemble, features, folds, learners
from tessera.operators import encode, profile, sample
from tessera.sources import readers, writers


@pytest.fixture(scope="module")
def two(spark):
    """Two classes that n_x parts, a category that follows them, and a column of noise."""
    x = F.col("id") / 10
    return spark.range(120).select(F.col("id").alias("rid"), x.alias("n_x"), (F.xxhash64("id") % 100 / 100.0).alias("n_noise"), F.when(x > 6, "high").otherwise("low").alias("c_side"), (x > 6).cast("double").alias("y")).cache()


def test_impute_categorical(two):
    gaps = two.withColumn("c_side", F.when(F.col("rid") % 6 != 0, F.col("c_side")))
    out = encode.impute_categorical(gaps.select("rid", "n_x", "c_side"), "c_side")
    assert out.where("c_side is null").count() == 0
    assert out.join(two.select("rid", F.col("c_side").alias("want")), "rid").where("c_side <> want").count() <= 6


def test_one_sparse_vector_of_all_columns(two):
    rows = encode.one_hot_vector(two.select("rid", "c_side", "n_x"), ["c_side"]).collect()
    assert all(r["features"].size >= 3 and abs(r["features"].toArray()[-1] - r["n_x"]) < 1e-12 for r in rows)


def test_tree_leaves(two):
    out = features.tree_features(two, "y", "rid", trees=3, k=2, columns=["n_x"])
    assert out.count() == 120 and {f"i_leaf_{t}" for t in range(3)} <= set(out.columns) and out.where("i_leaf_0 is null").count() == 0


def test_appended_transforms(two):
    ready = folds.assemble(two, ["n_x", "n_noise"], "v")
    out = features.append_fit_transform(ready, PCA(k=2, inputCol="v", outputCol="output"))
    assert {"n_new_col_0", "n_new_col_1"} <= set(out.columns) and out.count() == 120


def test_borderline_smote(spark):
    rows = [(i, float(i), int(i % 2 == 0 or i > 60)) for i in range(90)]
    df = spark.createDataFrame(rows, "rid long, n_a double, y int")
    made, safe, danger = features.borderline_smote(df, "y", 1, "rid", ["n_a"], 100, 4)
    near = {}
    for i, a, y in rows:
        if y == 1:
            others = sorted((abs(a - b), j, z) for j, b, z in rows if j != i)[:4]
            near[i] = sum(z == 0 for _, _, z in others)
    assert {r["rid"] for r in safe.collect()} == {i for i, n in near.items() if n < 2}
    assert {r["rid"] for r in danger.collect()} == {i for i, n in near.items() if 2 <= n < 4}
    assert made.count() == danger.count() and made.where("y <> 1").count() == 0


def test_wrappers_around_fits(two):
    ready = folds.assemble(two, ["n_x"])
    out = ensemble.trim_on_y_fit(LinearRegression(labelCol="n_x"), "n_x", 2.0, 8.0).fit(ready).transform(ready)
    assert out.count() == 120
    raw = LogisticRegression(labelCol="y").fit(ready).transform(ready)
    for mode in ("sigmoid", "minmax"):
        p = [r["proba"] for r in ensemble.probability_of(raw, mode).orderBy("n_x").collect()]
        assert 0 <= p[0] < p[-1] <= 1
    w = ensemble.optimise_any(two.withColumn("other", 1 - F.col("y")), "y", ["y", "other"], ensemble.neg_mse, rounds=2)
    assert w["y"] > w["other"] and abs(sum(w.values()) - 1) < 1e-9


def test_importances_and_searches(two):
    ready = folds.assemble(two, ["n_x", "n_noise"])
    names = [c for c, _ in folds.feature_importances(ready, RandomForestClassifier(labelCol="y", numTrees=5, seed=1), ["n_x", "n_noise"])]
    assert names == ["n_x", "n_noise"]
    forest = RandomForestClassifier(labelCol="y", numTrees=3, seed=1)
    assert set(folds.coordinate_search(ready, forest, "y", "rid", {"maxDepth": [1, 2], "numTrees": [2, 3]})) == {"maxDepth", "numTrees"}
    scores = folds.score_values(ready, forest, "y", "rid", "maxDepth", [1, 3])
    assert len(scores) == 2 and scores[0][0] >= scores[1][0]
    assert folds.cv_ohe(two, LogisticRegression(labelCol="y"), "y", "rid", n_iter=2)[0] > 0.9
    best = folds.score_operations(two.select("rid", "n_x", "y"), LogisticRegression(labelCol="y"), "y", "rid", ["n_x"], {"zero": lambda d, c: d.withColumn(c, F.lit(0.0))}, n_iter=2)
    assert best["n_x"][0] is None
    assert "maxDepth" in folds.explain_params(forest)


def test_learners(two):
    linear = learners.online_linear(["c_side"], "y", bits=8).fit(two).transform(two)
    assert linear.where("prediction <> y").count() == 0
    svm = learners.linear_svm(["c_side"], "y", bits=8).fit(two).transform(two)
    assert svm.where("prediction <> y").count() == 0
    assert learners.factorisation_machine(["n_x"], "n_x", classify=False, bits=4, passes=3).fit(two).transform(two).count() == 120


def test_profiles(two):
    view = profile.viz(two)
    assert view.header() == {"rows": 120, "columns": 5} and view.target("y").count() == 2
    assert set(view.relations("y")) == {"n_x", "n_noise", "c_side"}
    assert profile.histogram(two, "n_x", 4).agg(F.sum("n")).first()[0] == 120
    assert profile.union_all([two, two]).count() == 240


def test_names_templates_and_columns(spark, two):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "x"]).toDF("a", "a", "x")
    assert roles.ensure_unique_names(df).columns == ["a", "a_1", "x"]
    template = spark.createDataFrame([], "y double, rid int")
    assert roles.from_template(two, template).dtypes == [("y", "double"), ("rid", "int")]
    assert roles.infer_col_names(two.select("rid", "y")).columns[1] == "b_y" and roles.infer_col_name(two, "n_x") == "n_x"
    kept = sample.col_subsample(two, 0.4, seed=2).columns
    assert len(kept) == 2 and kept == sample.col_subsample(two, 0.4, seed=2).columns
    assert roles.is_binary(two, "y") and not roles.is_numerical(two, "c_side")


def test_timers_caches_and_files(spark, two, tmp_path, caplog):
    with caplog.at_level(logging.INFO, "tessera"), runtime.timed("a block"):
        pass
    assert "a block took" in caplog.text
    cache = runtime.PlanCache(1)
    kept = cache.get(two.select("rid"))
    assert cache.get(two.select("rid")) is kept and cache.get(two.select("y")).count() == 120 and len(cache.kept) == 1
    path = writers.save_reusable(two, str(tmp_path), "t")
    assert writers.save_reusable(two, str(tmp_path), "t") == path and spark.read.parquet(path).count() == 120
    for name in "ab":
        two.select("rid", F.col("n_x").alias("prediction")).write.parquet(str(tmp_path / name))
    joined = readers.read_predictions(spark, {n: str(tmp_path / n) for n in "ab"}, "rid")
    assert joined.columns == ["rid", "a", "b"] and joined.count() == 120
    assert readers.to_frame(spark, np.eye(2)).columns == ["0", "1"] and readers.to_frame(spark, pd.Series([1, 2], name="s")).count() == 2
    assert readers.to_frame(spark, two) is two
    for path in ("x.7z", "x.xlsx"):
        with pytest.raises((ImportError, Exception)):
            readers.read_df(spark, str(tmp_path / path)).count()
