"""Known values of the deterministic operators, on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import roles
from tessera.functions import dates, scalar
from tessera.operators import clean, encode, evaluate, order, profile, rows, sample, serialize, sets
from tessera.plans.dsl import engineer, parse
from tessera.sources import readers, writers


def values(df, column, by="rid"):
    return [r[column] for r in df.orderBy(by).collect()]


def near(found, wanted, tol=1e-3):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert (a is None) == (b is None), (found, wanted)
        assert a is None or abs(a - b) < tol, (found, wanted)


def frame(spark, schema, *data):
    names = schema.split(", ")
    return spark.createDataFrame([(i, *row) for i, row in enumerate(data)], ", ".join(["rid long", *names]))


def test_one_hot_orders_values(spark):
    df = encode.one_hot_encode(frame(spark, "c_1 string, n_1 double", ("a", 1.0), ("b", 2.0), ("c", 3.0)))
    assert [tuple(r)[:3] + (r["n_1"],) for r in df.orderBy("rid").collect()] == [(1, 0, 0, 1), (0, 1, 0, 2), (0, 0, 1, 3)]


def test_bins_are_right_closed(spark):
    df = frame(spark, "n_1 double", (1.0,), (2.0,), (3.0,))
    assert values(encode.bin_columns(df, ["n_1"], 2), "c_binned_n_1") == ["(0.998, 2]", "(0.998, 2]", "(2, 3]"]


def test_scale(spark):
    df = frame(spark, "n_2 double, n_3 double", *[(float(i), float(i + 3)) for i in range(1, 6)])
    near(values(clean.scale(df), "n_2"), [-1.2649, -0.6325, 0, 0.6325, 1.2649])
    near(values(clean.scale(df, min_max=(10, 20)), "n_3"), [10, 12.5, 15, 17.5, 20])
    assert values(clean.scale(df.withColumn("n_2", F.lit(1.0)), ["n_2"]), "n_2") == [None] * 5


def test_missing(spark):
    df = frame(spark, "c_1 string, n_2 double", ("a", 1.0), ("b", 2.0), ("c", 3.0), ("a", 1.0), (None, None))
    assert values(clean.missing(df, "mode", "none"), "c_1")[-1] == "a"
    for how, value in (("mode", 1), ("mean", 1.75), ("max", 3), ("min", 1), ("median", 1.5), ("max+1", 4), (-10, -10)):
        assert values(clean.missing(df, "none", how), "n_2")[-1] == value
    assert values(clean.missing(df, "f", "none"), "c_1")[-1] == "f"
    assert values(clean.missing(df), "n_2")[-1] is None


def test_missing_replaces_infinities(spark):
    df = frame(spark, "n_1 double", (1.0,), (math.inf,), (3.0,), (math.nan,))
    assert values(clean.missing(df, "none", "mean"), "n_1") == [1, 2, 3, 2]


def test_remove(spark):
    df = frame(spark, "n_1 double, n_2 double", (2.0, 1.0), (3.0, 2.0), (4.0, None), (2.0, 1.0), (None, 2.0))
    assert clean.remove_nas(df).count() == 3 and clean.remove_nas(df, "n_1").count() == 4
    with pytest.raises(ValueError):
        clean.remove(df)
    assert clean.remove(df, missing_threshold=0.1).columns == ["rid"]


def test_outliers_of_categories(spark):
    df = spark.range(42_000).select(F.col("id").alias("rid"), F.when(F.col("id") < 40_000, F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(F.lit("f"), F.lit("g")), (F.col("id") % 2 + 1).cast("int"))).alias("c_1"))
    out = encode.categorical_outliers(df, ["c_1"], 0.1, "others")
    assert {r[0]: r[1] for r in out.groupBy("c_1").count().collect()} == {"a": 10_000, "b": 10_000, "c": 10_000, "d": 10_000, "others": 2000}
    assert encode.categorical_outliers(df, ["c_1"], 0.1).where("c_1 = 'a'").count() == 12_000


def test_indexes(spark):
    df = frame(spark, "c_1 string, c_2 string", ("a", "c"), ("b", "d"), (None, None))
    out = encode.to_indexes(df)
    assert values(out, "i_1") == [0, 1, -1] and values(out, "i_2") == [0, 1, -1]


#: Small inputs and the results that they must give.
ENC = [("a", "a", 0), ("a", "a", 1), ("a", "b", 1), ("b", "b", 0), ("b", "b", 1), ("c", "c", 0)]


def test_counts_and_shares(spark):
    df = frame(spark, "c_1 string, c_2 string, y int", *ENC)
    assert values(encode.cats_to_count_of_samples(df), "c_1") == [3, 3, 3, 2, 2, 1]
    near(values(encode.cats_to_ratio_of_samples(df), "c_2"), [2 / 6, 2 / 6, 3 / 6, 3 / 6, 3 / 6, 1 / 6])
    assert values(encode.cats_to_count_of_binary_target(df, "y"), "c_1") == [2, 2, 2, 1, 1, 0]
    near(values(encode.cats_to_ratio_of_binary_target(df, "y"), "c_2"), [1 / 2, 1 / 2, 2 / 3, 2 / 3, 2 / 3, 0])
    with pytest.raises(ValueError):
        encode.cats_to_count_of_binary_target(df.withColumn("y", F.col("rid")), "y")


def test_target_statistics(spark):
    df = frame(spark, "c_1 string, c_2 string, y int", *[(a, b, i + 1) for i, (a, b, _) in enumerate(ENC)])
    out = encode.cats_to_stat(df, "y", "all", columns=["c_1", "c_2"])
    assert [c for c in out.columns if c.startswith("n_")] == [f"n_{c}_{s}" for s in encode.ALL_STATS for c in ("c_1", "c_2")]
    near(values(out, "n_c_1_mean"), [2, 2, 2, 4.5, 4.5, 6])
    near(values(out, "n_c_2_mean"), [1.5, 1.5, 4, 4, 4, 6])


def test_unseen_values_get_the_overall_statistic(spark):
    data = [(c, i + 1) for i, c in enumerate("aaabbc")] + [(c, None) for c in "aaabbcdd"]
    out = encode.cats_to_stat(frame(spark, "c_1 string, y int", *data), "y")
    near(values(out, "n_c_1_mean"), [2, 2, 2, 4.5, 4.5, 6, 2, 2, 2, 4.5, 4.5, 6, 3.5, 3.5])


def test_group_rare(spark):
    df = frame(spark, "c_1 string", *[(c,) for c in "aaabbc"], (None,))
    assert values(encode.group_rare(df, limit=1), "c_1") == [*"aaabb", "rare", None]
    assert values(encode.group_rare(df, top_x=1), "c_1") == ["a", "a", "a", "rare", "rare", "rare", None]
    with pytest.raises(ValueError):
        encode.group_rare(df)


#: Small inputs and the results that they must give.
ROLLED = {
    "sum": [None, None, 35, 40, 30, 29, 48], "mean": [None, None, 11.667, 13.333, 10, 9.667, 16], "median": [None, None, 12, 13, 13, 12, 12],
    "min": [None, None, 10, 12, 2, 2, 2], "max": [None, None, 13, 15, 15, 15, 34], "std": [None, None, 1.528, 1.528, 7, 6.807, 16.371],
    "var": [None, None, 2.333, 2.333, 49, 46.333, 268],
}


@pytest.mark.parametrize("name", ROLLED)
def test_rolling(spark, name):
    df = frame(spark, "n_1 long", (10,), (12,), (13,), (15,), (2,), (12,), (34,))
    out = engineer(df, f"rolling_{name}(n_1, 3)", order_by="rid")
    near(values(out, f"n_rolling_{name}(n_1,3)"), ROLLED[name])


def test_rolling_across_chunks(spark):
    df = spark.range(500).select(F.col("id").alias("rid"), (F.col("id") * 7 % 31).alias("n_1"))
    out = order.rolling(df, [("sum", "n_1", 9, "s")], "rid", chunk=16)
    x = [i * 7 % 31 for i in range(500)]
    assert values(out, "s") == [None] * 8 + [sum(x[i - 8 : i + 1]) for i in range(8, 500)]


def test_rolling_with_a_gap_is_null(spark):
    df = frame(spark, "n_1 long", (1,), (None,), (3,), (4,))
    assert values(order.rolling(df, [("sum", "n_1", 2, "s"), ("count", "n_1", 2, "k")], "rid"), "s") == [None, None, None, 7]


def test_expressions(spark):
    df = frame(spark, "c_1 string, c_2 string, n_1 long, n_2 long", ("a", "d", 1, 4), ("b", "e", 2, 5), ("c", "f", 3, 6))
    out = engineer(df, "concat(c_1, c_2); concat(c_1, n_2); pow(n_2, 2)")
    assert values(out, "c_concat(c_1,c_2)") == ["ad", "be", "cf"] and values(out, "c_concat(c_1,n_2)") == ["a4", "b5", "c6"]
    assert values(out, "n_pow(n_2,2)") == [16, 25, 36]
    nested = engineer(df, "mult(lg(mult(n_1, n_2)), lg(pow(n_1, 3)))")
    assert nested.columns[-4:] == ["n_mult(n_1,n_2)", "n_pow(n_1,3)", "n_lg(mult(n_1,n_2))", "n_lg(pow(n_1,3))", "n_mult(lg(mult(n_1,n_2)),lg(pow(n_1,3)))"][-4:]
    near(values(nested, nested.columns[-1]), [math.log(a * (a + 3)) * math.log(a**3) for a in (1, 2, 3)])
    assert len(engineer(df, "concat()").columns) == len(df.columns) + 1
    assert len(engineer(df, "div()").columns) == len(df.columns) + 2
    near(values(engineer(df, "safe_lg(n_1)"), "n_safe_lg(n_1)"), [0, math.log(2), math.log(3)])


@pytest.mark.parametrize("text", ["nothing(n_1)", "concat(c_1)", "__import__('os')", "n_1 + n_2", "lg(n_1, n_2)"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        engineer(frame(spark, "c_1 string, n_1 long, n_2 long", ("a", 1, 2)), text)


def test_parse_names():
    assert parse("mult( lg(n_1) , 2 )").name == "n_mult(lg(n_1),2)"


def test_rank(spark):
    df = frame(spark, "x long", *[(v,) for v in (5, 2, 7, 3, 5, 8, 1)])
    assert values(encode.to_rank(df, "x", normalise=False), "rank") == [4.5, 2, 6, 3, 4.5, 7, 1]
    near(values(encode.to_rank(df, "x"), "rank"), [0.5833, 0.1667, 0.8333, 0.3333, 0.5833, 1, 0])


def test_box_cox(spark):
    near(values(scalar.boxcox_columns(frame(spark, "x double", *[(float(v),) for v in (1, 2, 3, 4, 5)]), ["x"]), "x"), [0, 0.88892, 1.64392, 2.32328, 2.95143], 2e-3)
    near(values(scalar.boxcox_columns(frame(spark, "x double", *[(float(v),) for v in (1, 2, 3, 4, -1)]), ["x"]), "x"), [2.151, 3.301, 4.484, 5.694, 0], 5e-3)


def test_dates(spark):
    df = dates.to_dates(frame(spark, "col1 string", ("1997-01-01",), ("2005-05-12",), ("never",)), "col1")
    out = dates.break_down_dates(df).orderBy("rid").collect()
    assert [tuple(r)[1:] for r in out] == [(1997, 1, 2, 1, 199701, 2, 1), (2005, 5, 3, 2, 200505, 3, 19), (None,) * 7]


def test_row_statistics(spark):
    one = rows.numerical_stats(frame(spark, "n_1 double", (3.0,))).first()
    assert one["n_min"] == one["n_max"] == one["n_mean"] == one["n_median"] == one["n_sum"] == 3 and one["n_mad"] == 0
    assert one["n_kurt"] is None and one["n_sem"] is None and one["n_std"] is None


def test_noise_filters(spark):
    df = frame(spark, "n_1 double, n_2 double, n_3 double", (1.0, 5.0, 3.0))
    assert [rows.noise_filter(df, k).first()["n_1"] for k in ("maximum", "minimum")] == [5, 1]
    near([rows.noise_filter(df, "uniform").first()["n_1"]], [7 / 3])
    with pytest.raises(ValueError):
        rows.noise_filter(df, "median")


def test_names(spark):
    df = spark.createDataFrame([("a", "p", 1, 1.5), ("b", "q", 0, 2.5), ("c", "p", 1, 3.5)], "c1 string, c2 string, c3 int, c4 double").withColumn("c5", F.current_timestamp())
    assert roles.infer_col_names(df).columns == ["c_c1", "b_c2", "b_c3", "n_c4", "d_c5"]
    assert roles.unique_names(["c"] * 5) == ["c", "c_1", "c_2", "c_3", "c_4"]
    empty = spark.createDataFrame([], "c_1 int, c_2 int, c_3 int, n_1 int, n_2 int, n_3 int")
    assert len(roles.column_combinations(empty, categorical=True)) == 3
    assert len(roles.column_combinations(empty, categorical=True, numerical=True)) == 15


#: Small inputs and the results that they must give.
VW = [(0.23, 0.25, "2006", 0), (0.18, 0.15, "1976", 1), (0.53, 0.32, "1924", 0)]


def test_serialisers(spark):
    df = frame(spark, "n_price double, n_sqft double, c_year string, y int", *VW)
    assert values(serialize.to_vw(df, "rid", "y"), "line")[0] == "-1.0 |n 0:0.23 1:0.25 |c 2"
    assert values(serialize.to_libfm(df, "rid", "y"), "line")[0] == "0.0 0:0.23 1:0.25 2:1"
    assert values(serialize.to_svmlight(df, "rid", "y"), "line")[0] == "-1.0 1:0.23 2:0.25 3:1"
    weighted = df.withColumn("w", F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)), (F.col("rid") + 1).cast("int")))
    lines = values(serialize.to_vw(weighted, "rid", "y", "w"), "line")
    assert lines[0] == "-1.0 '0 |n 0:0.23 1:0.25 |c 2" and lines[1].startswith("1.0 2 '1 |n")
    with pytest.raises(ValueError):
        serialize.to_libffm(df, "rid", "y")
    assert values(serialize.to_libffm(df.drop("c_year"), "rid", "y"), "line")[0] == "0 0:0:0.23 1:0:0.25"


def test_sets(spark):
    a, b = frame(spark, "c_1 string", ("x",), ("y",), (None,)), frame(spark, "c_1 string", ("y",), ("z",))
    assert sorted((r[0] or "", r[1]) for r in sets.difference_with(a, b, "c_1").collect()) == [("", "left"), ("x", "left"), ("z", "right")]
    assert sets.append_bottom(a, b.drop("c_1")).count() == 5
    assert sets.is_equal(a, a, "rid") and not sets.is_equal(a, b, "rid")
    assert sets.hashcode(a) == sets.hashcode(a.orderBy("c_1")) != sets.hashcode(b)
    assert order.append_right(a, b, "rid").columns == ["rid", "c_1", "rid_1", "c_1_1"]


def test_trim(spark):
    df = spark.range(1000).withColumnRenamed("id", "y")
    assert [clean.trim_on_y(df, "y", *b).count() for b in ((100, None), (100, 500), (None, 250))] == [900, 401, 251]


def test_votes(spark):
    df = frame(spark, "a int, b int, c int", (1, 0, 1), (2, 1, 0), (0, 3, 3))
    pick = lambda how: values(df.withColumn("v", evaluate.vote(["a", "b", "c"], how)), "v")
    assert pick("majority") == [1, 0, 3] and pick("median") == [1, 1, 3] and pick("max") == [1, 2, 3] and pick("min") == [0, 0, 0]


def test_split_sizes(spark):
    df = spark.range(100).select(F.col("id").alias("rid"), (F.col("id") % 2).alias("y"))
    train, test = sample.split(df, "rid", 0.7, 3, "y")
    assert train.count() == 70 and test.count() == 28 or test.count() == 30
    assert train.join(test, "rid").count() == 0
    assert sorted(r[0] for r in sample.split(df, "rid", 0.7, 3, "y")[0].select("rid").collect()) == sorted(r[0] for r in train.select("rid").collect())
    assert sample.subsample(df, 0.25, "rid").count() == 25 and sample.subsample(df, 1000, "rid").count() == 100


def test_label_folds(spark):
    df = frame(spark, "l string", *[(c,) for c in "ccaabbdd"])
    assert values(sample.label_folds(df, "l", "rid", 2), "fold") == [0, 0, 0, 0, 1, 1, 1, 1]


def test_profile(spark):
    out = {r["column"]: r for r in profile.column_profile(frame(spark, "c_1 string, n_1 double", ("a", 1.0), ("a", 3.0), (None, None))).collect()}
    assert out["c_1"]["n_distinct"] == 1 and out["n_1"]["mean"] == 2 and out["n_1"]["n_null"] == 1 and out["c_1"]["role"] == "categorical"


def test_csv_round_trip(spark, tmp_path):
    df = spark.range(10_000).select(*[(F.col("id") + i).alias(f"col_{i}") for i in range(3)])
    path = str(tmp_path / "x.csv.gz")
    writers.save_csv(df, path)
    assert readers.read_df(spark, path).count() == 10_000
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.save_csv(df, path)
    writers.save_csv(df.limit(5), path, force=True)
    assert readers.read_df(spark, path, nrows=3).count() == 3


def test_zip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("one.csv", "a,b\n1,x\n2,y\n")
    assert [tuple(r) for r in readers.read_df(spark, str(tmp_path / "one.zip"), schema="a int, b string").collect()] == [(1, "x"), (2, "y")]


def test_reuse(spark, tmp_path):
    path, calls = str(tmp_path / "kept"), []
    compute = lambda: calls.append(1) or spark.range(3)
    assert readers.read_or_compute(spark, path, compute).count() == 3 == readers.read_or_compute(spark, path, compute).count()
    assert len(calls) == 1
    assert [len(c) for c in readers.chunks(spark.range(25), 10)] == [10, 10, 5]


def test_plans_stay_on_the_jvm(spark):
    df = frame(spark, "c_1 string, n_1 double, y double", ("a", 1.0, 2.0))
    for out in (clean.missing(df, "mode", "mean"), encode.cats_to_stat(df, "y"), rows.numerical_stats(df), order.rolling(df, [("sum", "n_1", 2, "s")], "rid")):
        assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
