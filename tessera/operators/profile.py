"""Profiles of tables: a row per column, and the relation of columns to a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import roles, stats
from tessera.operators import evaluate


def column_profile(df: DataFrame, columns=None) -> DataFrame:
    """(column, role, n, n_null, n_distinct, mean, variance, min, max) from one aggregation."""
    names = columns or df.columns
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
    aggs = []
    for i, c in enumerate(names):
        x = F.col(c)
        number = x.cast("double") if c in numeric else F.lit(None).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count_distinct(x).alias("n_distinct"),
            F.avg(number).alias("mean"), F.var_samp(number).alias("variance"), F.min(x).cast("string").alias("min"), F.max(x).cast("string").alias("max"),
        ).alias(f"x{i}"))
    one = df.agg(*aggs)
    role = F.create_map(*[F.lit(v) for p, r in roles.PREFIXES.items() for v in (p, r)])
    return one.select(F.explode(F.array(*[F.col(f"x{i}") for i in range(len(names))])).alias("x")).select("x.*").withColumn("role", role[F.substring("column", 1, 2)])


def feature_scores(df: DataFrame, y: str, columns=None) -> DataFrame:
    """(column, f_regression, f_classification, chi2, variance) of numerical columns, the largest F first."""
    names = columns or [c for c in roles.numericals(df) if c != y]
    a = evaluate.f_regression(df, names, y).withColumnRenamed("f_score", "f_regression")
    b = evaluate.f_classification(df, names, y).withColumnRenamed("f_score", "f_classification")
    low = dict(zip(names, df.agg(*[F.min(c) for c in names]).first()))
    shifted = df.select(y, *[(F.col(c) - F.lit(min(0, low[c] or 0))).alias(c) for c in names])
    out = a.join(b, "column").join(evaluate.chi2(shifted, names, y), "column")
    return out.join(column_profile(df, names).select("column", "variance"), "column").orderBy(F.desc("f_regression"))


def relation(df: DataFrame, column: str, target: str, bins: int = 30) -> DataFrame:
    """What a chart of two columns shows: counts of value pairs, five-number summaries by class, or a grid of bins."""
    kinds = [("number" if c[:2] == "n_" else "class") for c in (column, target)]
    if kinds == ["class", "class"]:
        return df.groupBy(column, target).agg(F.count("*").alias("n"))
    if kinds == ["number", "number"]:
        return df.groupBy(*[histogram_bin(df, c, bins).alias(c) for c in (column, target)]).agg(F.count("*").alias("n"))
    number, by = (column, target) if kinds[0] == "number" else (target, column)
    ends = df.groupBy(by).agg(F.min(number).alias("min"), F.max(number).alias("max"), F.count(number).alias("n"))
    inner = stats.quantiles(df.select(F.col(by).alias("_k"), F.col(number).alias("_v")), [0.25, 0.5, 0.75], ["_k"])
    return ends.join(inner, F.col(by).eqNullSafe(F.col("_k")), "left").select(by, "min", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "max", "n")


def histogram_bin(df: DataFrame, column: str, bins: int):
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    at = F.floor(F.try_divide((F.col(column).cast("double") - F.lit(low)) * bins, F.lit(high) - F.lit(low)))
    return F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(histogram_bin(df, column, bins).alias("bin")).agg(F.count("*").alias("n"))


def compare_predictions(df: DataFrame, y: str, p: str) -> DataFrame:
    """Covariance and agreement limits of continuous columns, else the confusion counts."""
    if df.schema[y].dataType.typeName() in ("double", "float"):
        return evaluate.covariance(df, y, p).crossJoin(F.broadcast(evaluate.bland_altman(df, y, p)))
    return evaluate.confusion(df, y, p)


def importances(df: DataFrame, y: str, columns=None, rows: int = 50_000, trees: int = 50, seed: int = 0) -> DataFrame:
    """(column, importance) by a random forest on at most `rows` rows, those with the smallest hashes of their values."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = columns or [c for c in roles.numericals(df) if c != y]
    some = df.select(*names, F.col(y).cast("double").alias("_y")).orderBy(F.xxhash64(*names, "_y")).limit(rows)
    ready = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip").transform(some)
    few = ready.agg(F.approx_count_distinct("_y")).first()[0] <= 10
    forest = (RandomForestClassifier if few else RandomForestRegressor)(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed).fit(ready)
    found = sorted(zip(names, forest.featureImportances.toArray().tolist()), key=lambda p: -p[1])
    return df.sparkSession.createDataFrame(found, "column string, importance double")


class Describe:
    """A table's profile, or a column's."""

    def __init__(self, df: DataFrame, column: str | None = None):
        self.df, self.column = df, column

    def header(self) -> dict:
        return {"rows": self.df.count(), "columns": len(self.df.columns)}

    def type(self) -> dict[str, str | None]:
        """Role of each column, or of the one described."""
        return roles.infer_roles(self.df, [self.column] if self.column else None)

    def summary(self) -> DataFrame:
        return column_profile(self.df, [self.column] if self.column else None)

    def details(self, y: str | None = None) -> DataFrame:
        """The profile with the role by name, the role by data, whether they differ, and scores and rank against a target.

        An index is a kind of categorical here, and whole numbers in a numerical column are no mismatch.
        """
        names = [self.column] if self.column else self.df.columns
        bare = self.df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
        found = roles.infer_roles(bare)
        kinds = [(c, roles.role_of(self.df, c), found[f"_{i}"]) for i, c in enumerate(names)]
        alike = {("categorical", "index"), ("numerical", "index"), ("index", "categorical"), ("numerical", "categorical"), ("categorical", "binary"), ("index", "binary"), ("numerical", "binary")}
        rows = [(c, a, b, bool(a and b and a != b and (a, b) not in alike)) for c, a, b in kinds]
        table = self.df.sparkSession.createDataFrame(rows, "column string, by_name string, by_data string, mismatch boolean")
        out = self.summary().join(table, "column", "left")
        if y is None:
            return out
        scores = feature_scores(self.df.where(F.col(y).isNotNull()), y, [c for c in roles.numericals(self.df) if c != y and c in names])
        place = Window.orderBy(F.desc_nulls_last("f_regression"), "column")
        # a row for each column of the table: as many as it has columns
        ranked = scores.drop("variance").withColumn("rank", F.row_number().over(place))
        return out.join(ranked, "column", "left")

    def target(self, y: str) -> DataFrame:
        return evaluate.value_counts(self.df, y)

    def relations(self, y: str) -> dict[str, DataFrame]:
        return {c: relation(self.df, c, y) for c in self.df.columns if c != y and c[:2] in ("c_", "i_", "b_", "n_")}


def viz(df: DataFrame, column: str | None = None) -> Describe:
    return Describe(df, column)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
