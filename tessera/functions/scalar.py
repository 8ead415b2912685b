"""Scalar functions as Columns: target transforms, link functions, activations, hashing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ln(c: Column) -> Column:
    """Natural logarithm, null where there is none."""
    return F.when(c > 0, F.ln(c))


def safe_sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


class YTransform:
    """A target transform and its inverse: 'log', 'log+s', 'arcsinh', 'pseudoLog10', a number, or two functions."""

    def __init__(self, op, shift: float = 0.0, inverse: Callable[[Column], Column] | None = None):
        self.op, self.shift, self.back = op, shift, inverse

    @classmethod
    def fit(cls, df: DataFrame, y: str, op) -> YTransform:
        """'log' shifts by -1.01 times a negative minimum."""
        if op == "log":
            low = df.agg(F.min(y)).first()[0]
            return cls(op, -1.01 * low if low is not None and low < 0 else 0.0)
        if isinstance(op, str) and op.startswith("log+"):
            return cls("log", float(op[4:]))
        return cls(op)

    def apply(self, y: Column) -> Column:
        if callable(self.op):
            return self.op(y)
        if self.op == "log":
            return safe_ln(y + self.shift)
        if self.op == "arcsinh":
            return F.asinh(y)
        if self.op == "pseudoLog10":
            return F.asinh(y / 2) / math.log(10)
        if isinstance(self.op, (int, float)):
            return y * float(self.op)
        raise ValueError(f"unknown transform: {self.op}")

    def invert(self, y: Column) -> Column:
        if callable(self.op):
            if self.back is None:
                raise ValueError("a function needs its inverse")
            return self.back(y)
        if self.op == "log":
            return F.exp(y) - self.shift
        if self.op == "arcsinh":
            return F.sinh(y)
        if self.op == "pseudoLog10":
            return F.sinh(y * math.log(10)) * 2
        if isinstance(self.op, (int, float)):
            return y / float(self.op)
        raise ValueError(f"unknown transform: {self.op}")


def sigmoid(p: Column) -> Column:
    """Probability of a raw score; below -100 it is 0."""
    return F.when(p < -100, F.lit(0.0)).otherwise(1 / (1 + F.exp(-p)))


def bounded_sigmoid(p: Column, bound: float = 35.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(p, F.lit(bound)), F.lit(-bound))))


def log_loss(p: Column, y: Column, eps: float = 1e-14) -> Column:
    """-ln of the probability given to the truth, kept off 0 and 1 by eps."""
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -F.ln(F.when(y == 1, p).otherwise(1 - p))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


#: Activations of random layers, of the projected input a.
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "sine": F.sin,
    "tanh": F.tanh,
    "tribas": lambda a: clip(1 - F.abs(a), 0.0, 1.0),
    "inv_tribas": lambda a: clip(F.abs(a), 0.0, 1.0),
    "sigmoid": lambda a: 1 / (1 + F.exp(-a)),
    "hardlim": lambda a: (a > 0).cast("double"),
    "softlim": lambda a: clip(a, 0.0, 1.0),
    "gaussian": lambda a: F.exp(-(a * a)),
    "multiquadric": lambda a: F.sqrt(1 + a * a),
    "inv_multiquadric": lambda a: 1 / F.sqrt(1 + a * a),
}


def grbf(a: Column, tau: float) -> Column:
    return F.exp(F.exp(-F.pow(a, F.lit(float(tau)))))


def hash_feature(column: str, bits: int = 20) -> Column:
    """Bucket of column=value among 2^bits."""
    return F.pmod(F.xxhash64(F.concat_ws("_", F.lit(column), F.col(column).cast("string"))), F.lit(1 << bits))


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def box_cox_lambda(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, rounds: int = 4, points: int = 41) -> float:
    """The power of the largest profile likelihood: a grid of powers in one aggregation, then a finer grid around it."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = [low + step * k for k in range(points)]
        row = df.where(x > 0).agg(F.sum(F.ln(x)), F.count(x), *[F.var_pop(box_cox(x, g)) for g in grid]).first()
        logs, n = row[0], row[1]
        score = [(g - 1) * logs - n / 2 * math.log(v) if v else -math.inf for g, v in zip(grid, row[2:])]
        best = grid[score.index(max(score))]
        low, high = best - step, best + step
    return best


def boxcox_columns(df: DataFrame, columns, safe: bool = True) -> DataFrame:
    """Box-Cox of each column by its own power; columns that reach 0 or below are first shifted to 1 + (x - min)."""
    row = df.agg(*[F.min(c) for c in columns]).first()
    for c, low in zip(columns, row):
        if safe and low is not None and low <= 0:
            df = df.withColumn(c, F.col(c) + F.lit(1 - low))
        df = df.withColumn(c, F.when(F.col(c) > 0, box_cox(F.col(c).cast("double"), box_cox_lambda(df, c))))
    return df
