"""Statistics and filters across the columns of a row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import roles


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def numerical_stats(df: DataFrame, columns=None, prefix: str = "n_") -> DataFrame:
    """n_min n_max n_kurt n_mad n_mean n_median n_sem n_std n_sum over a row's values, nulls left out.

    kurt is the bias-corrected excess (four values at least), mad the mean absolute deviation.
    """
    names = columns or roles.numericals(df)
    values = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in names]), lambda x: x.isNotNull()))
    df = df.withColumn("_v", values).withColumn("_n", F.size("_v").cast("double"))
    v, n = F.col("_v"), F.col("_n")
    df = df.withColumn("_mean", F.try_divide(_total(v), n))
    mean = F.col("_mean")
    moment = lambda k: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x - mean, F.lit(float(k))))
    df = df.withColumn("_m2", moment(2)).withColumn("_m4", moment(4))
    m2, m4 = F.col("_m2"), F.col("_m4")
    half = F.floor(n / 2).cast("int")
    upper, lower = F.get(v, half), F.get(v, half - 1)
    std = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    kurt = F.when((n > 3) & (m2 > 0), ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    new = {
        "min": F.get(v, F.lit(0)), "max": F.get(v, n.cast("int") - 1), "kurt": kurt,
        "mad": F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x - mean)), n), "mean": mean,
        "median": F.when(n % 2 == 1, upper).otherwise((upper + lower) / 2), "sem": std / F.sqrt(n), "std": std,
        "sum": F.when(n >= 0, _total(v)),
    }
    return df.withColumns({prefix + k: c for k, c in new.items()}).drop("_v", "_n", "_mean", "_m2", "_m4")


def _reflected(i: int, n: int) -> int:
    """The index that a mirror at either edge shows in place of i."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def noise_filter(df: DataFrame, kind: str, size: float = 3, columns=None) -> DataFrame:
    """`maximum`, `minimum`, `uniform` (of `size` neighbours) or `gaussian` (sigma `size`) across a row's columns."""
    names = columns or roles.numericals(df)
    n, x = len(names), [F.col(c).cast("double") for c in names]
    if kind not in ("maximum", "minimum", "uniform", "gaussian"):
        raise ValueError(f"unknown filter: {kind}")
    new = {}
    for i, c in enumerate(names):
        if kind == "gaussian":
            reach = int(4 * size + 0.5)
            weights = [math.exp(-0.5 * (k / size) ** 2) for k in range(-reach, reach + 1)]
            near = [x[_reflected(i + k, n)] * (w / sum(weights)) for k, w in zip(range(-reach, reach + 1), weights)]
            new[c] = sum(near[1:], near[0])
        else:
            lo = i - int(size) // 2
            near = [x[_reflected(k, n)] for k in range(lo, lo + int(size))]
            if kind == "uniform":
                new[c] = sum(near[1:], near[0]) / len(near)
            else:
                one = F.greatest if kind == "maximum" else F.least
                new[c] = one(*near) if len(near) > 1 else near[0]
    return df.withColumns(new)
