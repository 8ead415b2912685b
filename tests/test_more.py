"""Operators over keys of any type, columns without values, and fits on one table for another."""

import pickle
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera import roles, runtime, stats
from tessera.ml import ensemble, features, folds, learners
from tessera.operators import clean, encode, evaluate, order, profile, sample, sets
from tessera.sources import readers
from tessera.streaming import ftrl


@pytest.mark.parametrize("kind", ["string", "long", "double", "decimal(12,3)", "date", "timestamp"])
def test_positions_by_keys_of_any_type(spark, kind):
    rng = random.Random(3)
    keys = rng.sample(range(10_000), 400)
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    made = {"string": F.concat(F.lit("k"), "id"), "date": F.date_add(F.lit("2001-01-01"), F.col("id").cast("int")), "timestamp": F.timestamp_seconds(F.col("id") * 1000), "decimal(12,3)": (F.col("id") / 8).cast("decimal(12,3)")}
    df = df.withColumn("key", made.get(kind, F.col("id").cast(kind)))
    found = [r["id"] for r in order.with_position(df, "key", buckets=7).orderBy("_pos").collect()]
    want = sorted(keys, key=lambda k: f"k{k}") if kind == "string" else sorted(keys)
    assert found == want
    assert sorted(r["_pos"] for r in order.with_position(df, "key", buckets=7).collect()) == list(range(400))


def test_running_sums_with_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 11 == 0 else rng.randrange(12), rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, v long")
    found = {r["id"]: r["s"] for r in order.running_sum(df, "k", F.col("v"), "s", ["id"], buckets=5).collect()}
    ranked, total, want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 0, {}
    for i, _, v in ranked:
        want[i] = total
        total += v
    assert found == want


def test_ranks_and_codes_over_many_buckets(spark):
    values = [f"v{i % 37:02d}" for i in range(500)] + [None]
    df = spark.createDataFrame([(i, v, float(i % 41)) for i, v in enumerate(values)], "rid long, c_v string, n_x double")
    codes = {r["rid"]: r["i_v"] for r in encode.to_indexes(df, ["c_v"]).collect()}
    ordered = sorted({v for v in values if v})
    assert codes == {i: ordered.index(v) if v else -1 for i, v in enumerate(values)}
    ranks = {r["rid"]: r["rank"] for r in encode.to_rank(df, "n_x", normalise=False).collect()}
    xs = sorted(float(i % 41) for i in range(501))
    assert all(ranks[i] == np.mean([k + 1 for k, x in enumerate(xs) if x == float(i % 41)]) for i in range(0, 501, 50))


def test_no_task_gets_all_rows(spark):
    """Plans: what goes to one task has a row for each bucket at most."""
    df = spark.range(3000).select(F.col("id").alias("rid"), F.concat(F.lit("c"), F.col("id")).alias("c_v"), (F.col("id") % 7).cast("double").alias("n_x"))
    for out in (encode.to_indexes(df, ["c_v"]), encode.to_rank(df, "n_x"), order.rolling(df, [("sum", "n_x", 3, "r")], "rid"), sample.label_folds(df, "c_v", "rid"), order.append_right(df.select("c_v"), df.select("rid"), "c_v", "rid")):
        text = out._jdf.queryExecution().executedPlan().toString()
        for i, line in enumerate(lines := text.split("\n")):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate(keys=[_rs_" in " ".join(lines[i + 1 : i + 4]), "\n".join(lines[i : i + 6])


def test_exact_subsamples(spark, monkeypatch):
    monkeypatch.setattr(sample, "DRAW_BITS", 5)
    df = spark.range(777).withColumnRenamed("id", "rid")
    for size in (0.1, 0.5, 1, 300, 777, 5000):
        n = min(777, int(777 * size) if size < 1 else size)
        rows = [r[0] for r in sample.subsample(df, size, "rid", 4).collect()]
        assert len(rows) == len(set(rows)) == n
    small, large = ({r[0] for r in sample.subsample(df, n, "rid", 4).collect()} for n in (50, 200))
    assert small < large
    labelled = df.withColumn("y", F.when(F.col("rid") < 100, 1))
    assert sample.subsample(labelled, 0.5, "rid", label="y").count() == 50
    assert sample.subsample(df.limit(0), 0.5, "rid").count() == 0


def test_stratified_folds(spark):
    df = spark.range(103).select(F.col("id").alias("rid"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 3 == 0, None).otherwise("b").alias("y"))
    rows = sample.with_folds(df, 4, "rid", 1, stratify="y").groupBy("y", "fold").count().collect()
    by = {}
    for r in rows:
        by.setdefault(r["y"], []).append(r["count"])
    assert all(len(v) == 4 and max(v) - min(v) <= 1 for v in by.values()) and sum(map(sum, by.values())) == 103


def test_one_hot_refuses_too_many_values(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_HOT", 20)
    df = spark.range(100).select((F.col("id") % 50).cast("string").alias("c_many"), (F.col("id") % 3).cast("string").alias("c_few"))
    with pytest.raises(ValueError, match="one_hot_vector"):
        encode.one_hot_encode(df)
    assert encode.one_hot_encode(df, ["c_few"]).columns == ["oh_c_few_0", "oh_c_few_1", "oh_c_few_2", "c_many"]
    assert encode.one_hot_vector(df).count() == 100


def test_quantiles_and_modes_by_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c"]), rng.choice([None, 1.5, float(rng.randrange(40)), rng.random()])) for _ in range(900)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "c_k string, n_v double")
    found = {r["_k"]: r for r in stats.grouped(df, F.col("c_k"), F.col("n_v"), ["iqm", "mean", "mode", "median", "max"]).collect()}
    for k in {k for k, _ in rows}:
        v = [x for g, x in rows if g == k and x is not None]
        if not v:
            assert [found[k][f"_s{i}"] for i in range(5)] == [None] * 5
            continue
        lo, mid, hi = np.quantile(v, [0.25, 0.5, 0.75])
        mode = min(sorted(set(v)), key=lambda x: -v.count(x))
        assert np.allclose([found[k][f"_s{i}"] for i in range(5)], [(lo + hi) / 2, np.mean(v), mode, mid, max(v)])
    v = [x for _, x in rows if x is not None]
    whole = stats.overall(df, F.col("n_v"), ["median", "iqm", "min"])
    assert np.isclose(whole["median"], np.median(v)) and np.isclose(whole["iqm"], np.quantile(v, [0.25, 0.75]).mean()) and whole["min"] == min(v)
    assert stats.overall(df.limit(0), F.col("n_v"), ["median", "mode", "mean"]) == {"median": None, "mode": None, "mean": None}
    box = {r["c_k"]: r for r in profile.relation(df.withColumn("c_k", F.when(F.col("c_k") != "b", F.col("c_k"))), "n_v", "c_k").collect()}
    assert np.isclose(box[None]["median"], np.median([x for g, x in rows if g == "b" and x is not None])) and box["none"]["n"] == 0


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_quantiles_of_few_groups_shuffle_few_values(spark):
    n = 60_000
    df = spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("c_k"), ((F.col("id") * 7919) % n).cast("double").alias("n_y"))
    before = shuffled_rows(spark)
    row = encode.cats_to_stat(df, "n_y", "all").where("id = 0").first()
    assert shuffled_rows(spark) - before < n / 2
    v = [i * 7919 % n for i in range(0, n, 3)]
    lo, mid, hi = np.quantile(v, [0.25, 0.5, 0.75])
    assert np.allclose([row[f"n_c_k_{s}"] for s in encode.ALL_STATS], [np.mean(v), (lo + hi) / 2, mid, min(v), max(v)])


@pytest.mark.parametrize("few", [1, 1_000])
def test_quantiles_by_spans_of_few_and_many_groups(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW_GROUPS", few)
    rng = random.Random(4)
    odd = [0.0, -0.0, 7.0, 7.0, 7.0, float("inf"), -float("inf")]
    rows = [(rng.choice(["a", "b", None, str(rng.randrange(50))]), rng.choice([None, rng.choice(odd), rng.gauss(0, 1e9), float(rng.randrange(-5, 5))])) for _ in range(4_000)]
    df = spark.createDataFrame(rows, "_k string, _v double").repartition(7)
    shares = [0.0, 0.1, 0.5, 1.0]
    found = {r["_k"]: r for r in stats.quantiles(df, shares, ["_k"]).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(found) == set(groups)
    for k, v in groups.items():
        v = sorted(v)
        for i, p in enumerate(shares):
            a, b = v[int(np.floor(p * (len(v) - 1)))], v[int(np.ceil(p * (len(v) - 1)))]
            want = a + (b - a) * (p * (len(v) - 1) % 1) if np.isfinite([a, b]).all() else float("nan")
            assert np.isclose(found[k][f"q{i}"], want) or np.isnan([found[k][f"q{i}"], want]).all()
    flat = df.where("_v > -5e9 and _v < 5e9")
    whole = stats.quantiles(flat, [0.5], []).first()
    assert np.isclose(whole["q0"], np.median([v for _, v in rows if v is not None and abs(v) < 5e9]))
    assert stats.quantiles(df.limit(0), [0.5], ["_k"]).count() == 0


def test_numbers_alike_are_in_one_bucket(spark):
    values = [0.0, -0.0, 1.0, 2.0, float("nan"), float("inf"), -float("inf"), None] * 5
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id int, k double")
    found = {r["id"]: r["s"] for r in order.running_sum(df, "k", F.lit(1), "s", ["id"], buckets=6).collect()}
    rank = {None: 0, -float("inf"): 1, 0.0: 2, 1.0: 3, 2.0: 4, float("inf"): 5}
    placed = sorted(range(len(values)), key=lambda i: (rank.get(values[i], 6), i))
    assert [found[i] for i in placed] == list(range(len(values)))


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, None, None, None)], "rid long, n_x double, i_k int, c_v string")
    assert [r["c_binned_n_x"] for r in encode.bin_columns(df, ["n_x"]).collect()] == [None, None]
    assert encode.bin_columns(df, ["n_x"], labels=False).schema["c_binned_n_x"].dataType.typeName() == "integer"
    assert encode.group_rare(df, ["i_k"], limit=1).where("i_k is null").count() == 2
    assert stats.sigma_limits(df, "n_x") == (None, None)
    assert stats.sigma_limits(spark.createDataFrame([(5.0,)], "n_x double"), "n_x") == (5.0, 5.0)
    assert clean.outliers(df, 2).count() == 2
    assert encode.to_rank(df, "n_x").where("rank is null").count() == 2


def test_fit_on_one_table_predict_another(spark):
    train = folds.assemble(spark.range(80).select((F.col("id") / 10).alias("n_x"), (F.col("id") > 40).cast("double").alias("y")), ["n_x"])
    test = folds.assemble(spark.createDataFrame([(0.1,), (7.9,)], "n_x double"), ["n_x"])
    model = LogisticRegression(labelCol="y")
    assert [r["prediction"] for r in folds.predict(train, model, "y", test).orderBy("n_x").collect()] == [0, 1]
    proba = [r["proba"] for r in folds.predict_proba(train, model, "y", test).orderBy("n_x").collect()]
    assert all(abs(sum(p) - 1) < 1e-9 for p in proba) and proba[1][1] > 0.9
    low, high = (r["decision"] for r in folds.decision_function(train, model, "y", test).orderBy("n_x").collect())
    assert low < 0 < high
    assert folds.transform(train, model, "y", test).count() == 2 and folds.transform(train, model, "y").count() == 80
    some = train.withColumn("y", F.when(F.col("n_x") < 7, F.col("y")))
    assert folds.predict(some, model, "y").count() == 10
    pairs = [(train.where("n_x % 1 < 0.5"), train.where("n_x % 1 >= 0.5"))] * 2
    assert folds.do_cv(model, train, "y", "n_x", custom=pairs)[1] == 0
    out = folds.self_predict_proba(train, model, "n_x", 4, stratify="y")
    assert out.count() == 80


def test_calibration_out_of_fold(spark):
    """A row's own label has no part in its calibrated score."""
    df = spark.range(120).select(F.col("id").alias("rid"), (F.col("id") / 120).alias("p"), (F.col("id") % 7 / 7).alias("q"), F.when(F.col("id") % 10 != 9, (F.xxhash64("id") % 120 + 120 < F.col("id") * 2).cast("int")).alias("y")).cache()
    for method in ("sigmoid", "isotonic"):
        out = {r["rid"]: r for r in ensemble.calibrate_out_of_fold(df, "y", ["p", "q"], "rid", method, 4).collect()}
        assert len(out) == 120 and all(0 <= r["p_calibrated"] <= 1 and 0 <= r["q_calibrated"] <= 1 for r in out.values())
    flipped = df.withColumn("y", F.when(F.col("rid") == 50, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r["rid"]: r["p_calibrated"] for r in ensemble.calibrate_out_of_fold(d, "y", "p", "rid", k=4).where("rid = 50").collect()} for d in (df, flipped))
    # its class, and so its fold, changes with the label, but no fit on other folds holds the row
    assert a.keys() == b.keys() == {50}
    assert ensemble.calibrate(df, "y", "p").count() == 120


def test_greedy_by_indexes_and_resumed(spark):
    df = spark.range(200).select(F.rand(0).alias("y"), *[F.rand(i + 1).alias(f"p{i}") for i in range(5)]).cache()
    names, seen = [f"p{i}" for i in range(5)], []

    def score(y, p, picked):
        seen.append(list(picked))
        return ensemble.neg_mse(y, p) - 0.001 * len(picked)

    picks = ensemble.greedy_ensemble(df, "y", names, score, epochs=3)
    assert len(picks) == 3 and max(map(len, seen)) == 3 and [c for c, _ in picks] in seen
    whole = ensemble.greedy_ensemble(df, "y", names, epochs=4)
    resumed = ensemble.greedy_ensemble(df, "y", names, epochs=2, start=[c for c, _ in whole[:2]])
    assert [c for c, _ in resumed] == [c for c, _ in whole] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(resumed, whole))
    early = ensemble.greedy_ensemble(df, "y", names, epochs=4, start=[c for c, _ in whole], early_exit=True)
    assert len(early) >= 4


def test_split_models_keep_every_row(spark):
    df = folds.assemble(spark.range(30).select(F.col("id").alias("rid"), F.when(F.col("id") < 20, F.col("id") % 2).when(F.col("id") < 25, 7).alias("g"), F.col("id").cast("double").alias("n_x"), (F.col("id") * 2.0).alias("y")), ["n_x"])
    model = ensemble.SplitModels([LinearRegression(labelCol="y")] * 2, F.col("g")).fit(df.where("rid < 20"))
    out = model.transform(df)
    assert out.count() == 30 and out.where("prediction is null").count() == 10
    whole = ensemble.SplitModels([LinearRegression(labelCol="y")] * 2, F.col("g"), LinearRegression(labelCol="y").fit(df)).fit(df.where("rid < 20")).transform(df)
    assert whole.where("prediction is null").count() == 0


def test_feature_selection_on_a_validation_set(spark):
    df = spark.range(300).select(F.col("id").alias("rid"), F.rand(1).alias("n_a"), F.rand(2).alias("n_b"), F.rand(3).alias("n_c")).withColumn("y", 3 * F.col("n_a") + F.col("n_b")).cache()
    chosen = folds.feature_selection(df.where("rid < 200"), LinearRegression(labelCol="y"), "y", "rid", ["n_c", "n_b", "n_a"], validation=df.where("rid >= 200"), tolerance=1e-3, n_samples=150)
    assert chosen == ["n_a", "n_b"]


def test_all_estimators_and_settings(spark, monkeypatch):
    df = folds.assemble(spark.range(60).select(F.col("id").alias("rid"), (F.col("id") / 10).alias("n_x"), (F.col("id") / 5).alias("y")), ["n_x"])
    monkeypatch.setattr(folds, "default_estimators", lambda *_: {"linear": LinearRegression(labelCol="y"), "broken": LinearRegression(labelCol="none")})
    found = folds.try_all(df, "y", "rid", False)
    assert [f[0] for f in found] == ["linear", "broken"] and found[0][3] is None and "none" in found[1][3]
    grid = lambda: [p[2]["regParam"] for p in folds.do_gs(df, LinearRegression(labelCol="y"), "y", "rid", {"regParam": [0.0, 50.0]})]
    assert grid() == [0.0, 50.0]
    with runtime.configured(higher_is_better=False, parallel=1):
        assert grid() == [50.0, 0.0]
    assert runtime.config().higher_is_better


def test_radial_layers(spark):
    df = spark.range(50).select((F.col("id") / 10).alias("n_x"), (F.col("id") % 7).cast("double").alias("n_z"), F.sin(F.col("id") / 10).alias("y"))
    layer = features.grbf_layer(units=12, seed=1).fit(df, ["n_x", "n_z"])
    gaps = np.linalg.norm(layer.centres[:, None] - layer.centres[None], axis=2)
    assert np.allclose(layer.radius, (gaps + np.where(np.eye(12, dtype=bool), np.inf, 0)).min(1))
    x = np.array([r[:2] for r in df.collect()])
    hidden = np.array([r[0] for r in layer.transform(df).select("hidden").collect()])
    far = np.linalg.norm(x[:, None] - layer.centres[None], axis=2) / layer.radius
    assert np.allclose(hidden, np.exp(np.exp(-(far**2.0))))
    assert features.ELM(features.rbf_layer(units=10, seed=2)).fit(df, ["n_x", "n_z"], "y").transform(df).count() == 50
    classes = df.withColumn("y", (F.col("n_x") > 2.5).cast("int"))
    assert features.ELM(features.mlp_layer(units=12, seed=3), classify=True).fit(classes, ["n_x"], "y").score(classes, "y") > 0.9


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    b = a.orderBy(F.desc("k"))
    c = spark.createDataFrame([(3, "x"), (2, "y"), (1, "z")], "k long, v string")
    assert sets.hashcode(a) == sets.hashcode(b) != sets.hashcode(c)
    assert sets.hashcode(a, "k") == sets.hashcode(b, "k") != sets.hashcode(a, "v") or sets.hashcode(a, "k") == sets.hashcode(a, "v")
    swapped = a.withColumn("k", 4 - F.col("k"))
    assert sets.hashcode(a.drop("k").withColumn("o", F.col("v"))) == sets.hashcode(swapped.drop("k").withColumn("o", F.col("v")))
    assert sets.hashcode(a, "k") != sets.hashcode(swapped, "k") and sets.nbytes(a) == 3 * 28


def test_sparse_columns(spark):
    df = spark.createDataFrame([(Vectors.sparse(3, {0: 1.0}), Vectors.dense([1.0]), 1)], ["s", "d", "x"])
    assert sets.is_sparse(df, "s") and not sets.is_sparse(df, "d") and not sets.is_sparse(df, "x") and not sets.is_sparse(df.limit(0), "s")


def test_roles_from_metadata_and_data(spark):
    df = spark.createDataFrame([("a", 1.5, 1, None), ("b", 2.5, 2, None), (None, None, 3, None), ("c", 0.5, 1, None)], "word string, size double, three long, none string")
    assert roles.categoricals(df) == [] and roles.numericals(df) == []
    ready = roles.annotate(df)
    assert roles.categoricals(ready) == ["word"] and roles.numericals(ready) == ["size"] and roles.indexes(ready) == ["three"]
    assert clean.missing(ready, "mode", "mean").where("word is null or size is null").count() == 0
    two = spark.range(5000).select((F.col("id") % 2).alias("two"), F.when(F.col("id") == 17, 1.0).otherwise(F.col("id") % 2 * 2.0).alias("three"))
    assert roles.infer_roles(two) == {"two": "binary", "three": "categorical"}


def test_details_of_columns(spark):
    df = spark.range(60).select(F.col("id").alias("n_id"), (F.col("id") / 7).alias("n_x"), (F.col("id") / 7).alias("c_number"), (F.col("id") * 2.0).alias("y"))
    rows = {r["column"]: r for r in profile.viz(df).details("y").collect()}
    assert rows["c_number"]["mismatch"] and not rows["n_x"]["mismatch"] and rows["n_id"]["by_data"] == "index"
    assert {rows["n_x"]["rank"], rows["n_id"]["rank"]} == {1, 2} and rows["c_number"]["rank"] is None
    assert profile.viz(df, "n_x").type() == {"n_x": "numerical"} and profile.viz(df, "n_x").details().count() == 1
    assert profile.importances(df.select("n_id", "n_x", "y"), "y", trees=5).count() == 2


def test_reliability_of_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 1), (0.95, 0), (0.0, 1)], "p double, y int")
    rows = {r["bin"]: r for r in evaluate.reliability_curve(df, "y", "p").collect()}
    assert sorted(rows) == list(range(1, 11)) and rows[5]["n"] == 0 and rows[5]["mean_score"] is None and rows[1]["n"] == 1


def test_ftrl_holdout_and_restart(spark, tmp_path):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c_1"), (F.col("id") % 2).cast("int").alias("y"))
    model = ftrl.fit(df, ["c_1"], "y", ftrl.FTRL(bits=8, alpha=0.5), epochs=4, holdout=5)
    assert len(model.holdout_loss) == 4 and model.holdout_loss[-1] < model.holdout_loss[0]
    df.where("y = 0").write.parquet(str(tmp_path / "in"))

    def run(state):
        q = ftrl.fit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["c_1"], "y", state, str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
        return state

    first = run(ftrl.FTRL(bits=8))
    # a restart with nothing new holds what was learned, and goes on from there
    again = run(ftrl.FTRL(bits=8))
    assert np.abs(first.z).sum() > 0 and np.array_equal(again.z, first.z) and np.array_equal(again.n, first.n)
    df.where("y = 1").write.mode("append").parquet(str(tmp_path / "in"))
    more = run(ftrl.FTRL(bits=8))
    assert not np.array_equal(more.z, first.z)


def test_lines_piped_through_a_program(spark):
    lines = spark.range(20).select("id", F.col("id").cast("string").alias("line"))
    found = {r["id"]: r["prediction"] for r in learners.pipe_lines(lines, "sed 's/$/.5 # note/'", "id").collect()}
    assert found == {i: i + 0.5 for i in range(20)}
    with pytest.raises(Exception, match="came out"):
        learners.pipe_lines(lines, "head -c 0").collect()


def test_saved_arrays_pickles_and_bare_names(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    (tmp_path / "b.pickle").write_bytes(pickle.dumps([[1.5], [2.5]]))
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    assert readers.read_or_compute(spark, str(tmp_path / "a")).count() == 3
    assert [r[0] for r in readers.read_or_compute(spark, str(tmp_path / "b.pickle")).collect()] == [1.5, 2.5]
    assert readers.read_or_compute(spark, str(tmp_path / "c")).count() == 3
    made = readers.read_or_compute(spark, str(tmp_path / "d"), lambda: spark.range(4))
    assert made.count() == 4 and readers.read_or_compute(spark, str(tmp_path / "d"), lambda: spark.range(9)).count() == 4
    assert readers.read_or_compute(spark, str(tmp_path / "e"), fail_if_missing=False) is None
    with pytest.raises(FileNotFoundError):
        readers.read_or_compute(spark, str(tmp_path / "e"))
