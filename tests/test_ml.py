"""Properties of model helpers: coverage, bounds, reproducibility."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera.functions.scalar import YTransform
from tessera.ml import ensemble, features, folds
from tessera.streaming import ftrl


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(200).select(F.col("id").alias("rid"), (F.col("id") / 10).alias("n_x"), (F.col("id") / 5 + 1 + F.rand(1) * 0.01).alias("y")).cache()


def test_out_of_fold_covers_every_row_once(line):
    out = folds.self_predict(folds.assemble(line, ["n_x"]), LinearRegression(labelCol="y"), "rid", 4)
    assert out.select("rid").distinct().count() == out.count() == 200
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.1


def test_cv_and_grid(line):
    mean, sem = folds.cv(line, LinearRegression(labelCol="y"), "y", "rid")
    assert mean > 0.99 and sem < 0.01
    best = folds.do_gs(folds.assemble(line, ["n_x"]), LinearRegression(labelCol="y"), "y", "rid", {"regParam": [0.0, 10.0]})
    assert best[0][2] == {"regParam": 0.0}


def test_wrapped_models(line):
    ready = folds.assemble(line, ["n_x"])
    out = ensemble.transform_y(LinearRegression(labelCol="y"), "y", YTransform("log")).fit(ready).transform(ready)
    assert out.where("prediction <= 0").count() == 0
    floor = ensemble.min_y_value(LinearRegression(labelCol="y"), "y", 20.0).fit(ready).transform(ready)
    assert floor.agg(F.min("prediction")).first()[0] == 20


def test_split_models(spark, line):
    ready = folds.assemble(line, ["n_x"])
    model = ensemble.SplitModels([LinearRegression(labelCol="y")] * 2, (F.col("rid") % 2).cast("int")).fit(ready)
    assert model.transform(ready).count() == 200
    with pytest.raises(ValueError):
        ensemble.SplitModels([LinearRegression(labelCol="y")], (F.col("rid") % 2).cast("int")).fit(ready)


@pytest.mark.parametrize("more", [0, 1])
def test_greedy_ensemble_uses_each_model_at_most_so_often(spark, more):
    df = spark.range(100).select(F.rand(0).alias("y"), *[F.rand(i + 1).alias(f"p{i}") for i in range(20)])
    picks = [c for c, _ in ensemble.greedy_ensemble(df, "y", [f"p{i}" for i in range(20)], epochs=10, max_replacements=more)]
    assert len(picks) == 10 and max(picks.count(c) for c in picks) <= more + 1
    few = ensemble.greedy_ensemble(df, "y", ["p0", "p1"], epochs=10, max_replacements=more)
    assert len(few) == 2 * (more + 1)


def test_weights(spark):
    df = spark.range(500).select(F.rand(3).alias("a"), F.rand(4).alias("b")).withColumn("y", 0.7 * F.col("a") + 0.3 * F.col("b"))
    w = ensemble.optimise_weights(df, "y", ["a", "b"])
    assert abs(w["a"] - 0.7) < 1e-3 and abs(sum(w.values()) - 1) < 1e-9


def test_calibration_is_monotone(spark):
    df = spark.range(300).select((F.col("id") / 300).alias("p"), (F.rand(5) < F.col("id") / 300).cast("int").alias("y"))
    for method in ("sigmoid", "isotonic"):
        c = [r[0] for r in ensemble.calibrate(df, "y", "p", method).orderBy("p").select("calibrated").collect()]
        assert all(a <= b + 1e-12 for a, b in zip(c, c[1:])) and 0 <= c[0] and c[-1] <= 1


def test_pca(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -1.0 * i) for i in range(5)], "n_1 double, n_2 double, n_3 double")
    out = features.pca(df, 2).orderBy("n_1").collect()
    assert abs(sum(r["n_pca_0"] for r in out)) < 1e-9 and all(abs(r["n_pca_1"]) < 1e-6 for r in out)


def test_smote_lies_between_neighbours(spark):
    df = spark.range(60).select(F.col("id").alias("rid"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("n_a"), (F.col("id") * 2.0).alias("n_b"))
    out = features.smote(df, "y", 1, "rid", ["n_a", "n_b"], 200, 2).collect()
    assert len(out) == 40 and all(abs(r["n_b"] - 2 * r["n_a"]) < 1e-6 and 0 <= r["n_a"] <= 57 for r in out)
    assert features.smote(df, "y", 1, "rid", ["n_a", "n_b"], 50, 2).count() == 10


def nearest_by_force(rows, few, k):
    return {i: [j for _, j in sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows.items() if j != i)[:k]] for i, v in rows.items() if i in few}


@pytest.mark.parametrize("values", [1 << 13, 64])
def test_neighbours_against_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr("tessera.ml.nearest.BLOCK_VALUES", values)
    rng = np.random.default_rng(3)
    # clusters, equal rows, ties on a grid, and a row far beyond all
    parts = [rng.normal(size=(200, 2)) * 50, rng.integers(0, 8, (200, 2)) * 1.0, np.full((40, 2), 3.0), [[1e9, 1e9]]]
    rows = dict(enumerate(np.concatenate(parts)))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in rows.items()], "rid long, n_a double, n_b double")
    ready = features.VectorAssembler(inputCols=["n_a", "n_b"], outputCol="_v").transform(df)
    found = {}
    for r in features.neighbours(ready.where("rid % 3 <> 1"), ready, "rid", "_v", 4).orderBy("distance", "neighbour").collect():
        found.setdefault(r["rid"], []).append(r["neighbour"])
    assert found == nearest_by_force(rows, {i for i in rows if i % 3 != 1}, 4)


def test_a_row_far_away_has_its_neighbours(spark):
    # beyond 128 standard deviations, its own distance among them
    df = spark.range(20_001).select(F.col("id").alias("rid"), F.when(F.col("id") == 20_000, 1e9).otherwise(F.col("id") % 50).alias("n_a"))
    ready = features.VectorAssembler(inputCols=["n_a"], outputCol="_v").transform(df)
    found = features.neighbours(ready.where("rid = 20000 or rid < 3"), ready, "rid", "_v", 3).collect()
    assert sorted(r["neighbour"] for r in found if r["rid"] == 20_000) == [49, 99, 149]
    assert len(found) == 12


def test_elm_learns_a_line(spark, line):
    out = features.ELM(features.mlp_layer(units=15, seed=2)).fit(line, ["n_x"], "y").transform(line)
    assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1.5


def test_ftrl(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c_1"), (F.col("id") % 2).cast("int").alias("y"))
    model = ftrl.fit(df, ["c_1"], "y", ftrl.FTRL(bits=8, alpha=0.5), epochs=5)
    p = {r[0]: r[1] for r in ftrl.predict(df, ["c_1"], model).select("c_1", "prediction").distinct().collect()}
    assert p["a"] < 0.35 and p["b"] > 0.65
    again = ftrl.FTRL.load(model.dump())
    assert np.array_equal(again.z, model.z)


def test_ftrl_stream(spark, tmp_path):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c_1"), (F.col("id") % 2).cast("int").alias("y"))
    df.write.parquet(str(tmp_path / "in"))
    model = ftrl.FTRL(bits=8)
    run = ftrl.fit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["c_1"], "y", model, str(tmp_path / "c"))
    run.processAllAvailable()
    run.stop()
    assert np.abs(model.z).sum() > 0
