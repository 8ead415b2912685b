"""Date columns: parsing and decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles


def to_dates(df: DataFrame, columns, drop: bool = True, fmt: str | None = None) -> DataFrame:
    """d_<c> parsed from strings; what cannot be parsed is null."""
    names = [columns] if isinstance(columns, str) else list(columns)
    parse = (lambda c: F.try_to_timestamp(F.col(c), F.lit(fmt))) if fmt else (lambda c: F.try_to_timestamp(F.col(c)))
    df = df.withColumns({"d_" + c: parse(c) for c in names})
    return df.drop(*names) if drop else df


def break_down_dates(df: DataFrame, columns=None, level: int = 3, drop: bool = True) -> DataFrame:
    """c_<d>_year, _month; from level 1 _dayofweek (Monday 0), _quarter; from 2 _year_and_month, _weekday, _weekofyear (ISO)."""
    names = columns or roles.dates(df)
    new = {}
    for d in names:
        c, p = F.col(d), "c_" + d
        new |= {f"{p}_year": F.year(c), f"{p}_month": F.month(c)}
        if level >= 1:
            new |= {f"{p}_dayofweek": F.weekday(c), f"{p}_quarter": F.quarter(c)}
        if level >= 2:
            new |= {f"{p}_year_and_month": F.year(c) * 100 + F.month(c), f"{p}_weekday": F.weekday(c), f"{p}_weekofyear": F.weekofyear(c)}
    df = df.withColumns(new)
    return df.drop(*names) if drop else df


def month_counts(df: DataFrame, column: str, output: str = "n") -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull()).groupBy((F.year(c) * 100 + F.month(c)).alias("month")).agg(F.count("*").alias(output))


def compare_distribution(left: DataFrame, right: DataFrame, column: str, right_column: str | None = None) -> DataFrame:
    """(month, n_left, n_right): rows a month of two date columns."""
    a, b = month_counts(left, column, "n_left"), month_counts(right, right_column or column, "n_right")
    return a.join(b, "month", "full").select("month", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
