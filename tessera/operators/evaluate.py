"""Aggregates that evaluate columns, targets and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import log_loss


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), nulls included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def percentage_positive(df: DataFrame, column: str, positive=True) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(column).eqNullSafe(F.lit(positive)), 1.0).otherwise(0.0)).alias("share"))


def covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.covar_samp(a, b).alias("covariance"), F.corr(a, b).alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks, over rows that have both."""
    from tessera.operators.encode import to_rank

    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = to_rank(to_rank(both, "_a", "_ra", False), "_b", "_rb", False)
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def f_regression(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, f_score): r^2 / (1 - r^2) * (n - 2) of each column with the target, in one aggregation."""
    aggs = [f for i, c in enumerate(columns) for f in (F.corr(c, y).alias(f"r{i}"), F.count_if(F.col(c).isNotNull() & F.col(y).isNotNull()).alias(f"n{i}"))]
    one = df.agg(*aggs)
    r2 = lambda i: F.col(f"r{i}") * F.col(f"r{i}")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.try_divide(r2(i), 1 - r2(i)).alias("q"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("x")).select("x.column", (F.col("x.q") * (F.col("x.n") - 2)).alias("f_score"))


def _class_sums(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, y, n, s, q): count, sum and sum of squares of each column in each class."""
    part = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("_y")).agg(*[f for i, c in enumerate(columns) for f in (F.count(c).alias(f"n{i}"), F.sum(F.col(c).cast("double")).alias(f"s{i}"), F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)]))
    return part.select("_y", rows.alias("x")).select("_y", "x.*")


def f_classification(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, f_score): one-way analysis of variance over the classes."""
    sums = _class_sums(df, columns, y).groupBy("column").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("n"))).alias("b"), F.count("*").alias("k"))
    between, within = F.col("b") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("q") - F.col("b")
    return sums.select("column", F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k"))).alias("f_score"))


def chi2(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, chi2): of the sums of a non-negative column by class against those that class sizes give."""
    sums = _class_sums(df, columns, y)
    total = sums.groupBy("column").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    both = sums.join(total, "column").withColumn("e", F.try_divide(F.col("all_s") * F.col("n"), F.col("all_n")))
    return both.groupBy("column").agg(F.sum(F.try_divide((F.col("s") - F.col("e")) * (F.col("s") - F.col("e")), F.col("e"))).alias("chi2"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def reliability_curve(df: DataFrame, y: str, score: str, bins: int = 10, normalise: bool = False) -> DataFrame:
    """(bin, mean_score, mean_truth, n) of all bins (a, b] over 0..1, empty ones too; a score of 0 is in no bin."""
    s = F.col(score).cast("double")
    if normalise:
        low, high = df.agg(F.min(s), F.max(s)).first()
        s = F.try_divide(s - F.lit(low), F.lit(high) - F.lit(low))
    df = df.withColumn("_s", s).withColumn("bin", F.ceil(F.col("_s") * bins).cast("int")).where(F.col("bin").between(1, bins))
    found = df.groupBy("bin").agg(F.avg("_s").alias("mean_score"), F.avg(F.col(y).cast("double")).alias("mean_truth"), F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bland_altman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference and its limits, by the population deviation."""
    d = F.col(a) - F.col(b)
    one = df.agg(F.avg(d).alias("md"), F.stddev_pop(d).alias("sd"))
    return one.select("md", "sd", (F.col("md") - 2 * F.col("sd")).alias("lower"), (F.col("md") + 2 * F.col("sd")).alias("upper"))


def mean_and_error(df: DataFrame, column: str) -> DataFrame:
    """Mean and standard error of fold scores."""
    return df.agg(F.avg(column).alias("mean"), F.try_divide(F.stddev_samp(column), F.sqrt(F.count(column).cast("double"))).alias("sem"))


def mean_log_loss(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.agg(F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"))


def roc_auc(df: DataFrame, y: str, score: str) -> float:
    """Area under the ROC curve from counts by score: only distinct scores are sorted, bucket by bucket."""
    from tessera.operators.order import running_sum

    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    row = running_sum(by, "s", F.col("n"), "b").agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), F.sum("p"), F.sum("n")).first()
    return row[0] / (row[1] * row[2])


def vote(columns: list[str], how: str = "majority", weights: list[float] | None = None) -> Column:
    """The vote of prediction columns: 'majority' (least on ties), 'mean' (weighted), 'median', 'max' or 'min'."""
    x = [F.col(c) for c in columns]
    if how == "majority":
        values = F.array(*x)
        tally = F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct((-F.size(F.filter(values, lambda u: u == v))).alias("n"), v.alias("v")))
        return F.array_min(tally)["v"]
    if how == "mean":
        w = weights or [1.0] * len(x)
        out = x[0] * w[0]
        for c, k in zip(x[1:], w[1:]):
            out = out + c * k
        return out / sum(w)
    if how == "median":
        s, n = F.array_sort(F.array(*[c.cast("double") for c in x])), len(x)
        return (s[(n - 1) // 2] + s[n // 2]) / 2
    if how in ("max", "min"):
        one = F.greatest if how == "max" else F.least
        return one(*x) if len(x) > 1 else x[0]
    raise ValueError(f"unknown vote: {how}")


def vote_class(columns: list[str], how: str = "mean", weights=None) -> Column:
    """1 where the voted probability is above one half."""
    return (vote(columns, how, weights) > 0.5).cast("int")
