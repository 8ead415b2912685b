"""Imputation, scaling, clipping and removal. Statistics of all columns come from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles, stats


def _with(df: DataFrame, new: dict) -> DataFrame:
    return df.withColumns(new) if new else df


def remove(df: DataFrame, columns=None, categoricals=False, numericals=False, dates=False, binaries=False, missing_threshold: float | None = None) -> DataFrame:
    """Drop columns by name or role, and those with a null share above the threshold but not 1; unknown names are ignored."""
    if not any((columns, categoricals, numericals, dates, binaries, missing_threshold is not None)):
        raise ValueError("nothing to remove was selected")
    drop = set([columns] if isinstance(columns, str) else columns or [])
    for wanted, found in ((categoricals, roles.categoricals), (numericals, roles.numericals), (dates, roles.dates), (binaries, roles.binaries)):
        drop |= set(found(df)) if wanted else set()
    if missing_threshold is not None:
        row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in df.columns]).first()
        drop |= {c for c, share in zip(df.columns, row) if share is not None and missing_threshold < share < 1}
    return df.drop(*drop)


def remove_nas(df: DataFrame, columns=None) -> DataFrame:
    return df.dropna("any", subset=[columns] if isinstance(columns, str) else columns)


def trim_on_y(df: DataFrame, y: str, min_y=None, max_y=None) -> DataFrame:
    if min_y is not None:
        df = df.where(F.col(y) >= min_y)
    return df if max_y is None else df.where(F.col(y) <= max_y)


def missing(df: DataFrame, categorical_fill="none", numerical_fill="none") -> DataFrame:
    """Fill nulls of categorical-like and of numerical columns with a constant, or each with a statistic of its own.

    Numerical fills also replace infinities and NaN; dates are never filled; 'none' leaves a kind alone.
    """
    wanted, fixed = {}, {}
    for names, fill in ((roles.categorical_like(df), categorical_fill), (roles.numericals(df), numerical_fill)):
        if fill == "none":
            continue
        for c in names:
            (wanted if fill in stats.NAMED else fixed)[c] = fill
    found = stats.aggregates(df, wanted) | fixed
    numbers = set(roles.numericals(df))
    return _with(df, {c: F.coalesce(stats.finite(F.col(c), stats.is_floating(df, c)) if c in numbers else F.col(c), F.lit(v).cast(_fill_type(df, c, v))) for c, v in found.items()})


def _fill_type(df: DataFrame, column: str, value):
    kind = df.schema[column].dataType
    return "double" if isinstance(value, float) and not value.is_integer() and not stats.is_floating(df, column) else kind


def scale(df: DataFrame, columns=None, min_max: tuple[float, float] | None = None) -> DataFrame:
    """z-scores by the sample deviation, or the range mapped to min_max; constant columns become null."""
    names = columns or roles.numericals(df)
    aggs = [f(c) for c in names for f in ((F.min, F.max) if min_max else (F.avg, F.stddev_samp))]
    if not aggs:
        return df
    row = df.agg(*aggs).first()
    new = {}
    for i, c in enumerate(names):
        a, b = row[2 * i], row[2 * i + 1]
        x = F.col(c).cast("double")
        if min_max:
            lo, hi = min_max
            new[c] = F.try_divide(x - F.lit(a), F.lit(b) - F.lit(a)) * (hi - lo) + lo
        else:
            new[c] = F.try_divide(x - F.lit(a), F.lit(b))
    return df.withColumns(new)


def normalise(df: DataFrame, columns=None) -> DataFrame:
    return scale(df, columns, (0.0, 1.0))


def outliers(df: DataFrame, stds: float = 3, columns=None) -> DataFrame:
    """Clip to the mean and `stds` sample deviations either side."""
    names = columns or roles.numericals(df)
    row = df.agg(*[f(c) for c in names for f in (F.avg, F.stddev_samp)]).first()
    new = {}
    for i, c in enumerate(names):
        mean, std = row[2 * i], row[2 * i + 1]
        if mean is not None and std is not None:
            new[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(mean - stds * std)), F.lit(mean + stds * std)))
    return _with(df, new)


def floor_at(df: DataFrame, column: str, least: float) -> DataFrame:
    """Values below `least` become `least`; nulls stay."""
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.col(column), F.lit(least))))


def split_train_test(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a label, rows without."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def floats_to_ints(df: DataFrame, decimals: int = 5, columns=None) -> DataFrame:
    """Floating columns times 10^decimals, truncated to whole numbers."""
    names = columns or [c for c in df.columns if stats.is_floating(df, c)]
    return _with(df, {c: (F.col(c) * float(10**decimals)).cast("bigint") for c in names})


_WIDTHS = (("byte", 7), ("short", 15), ("int", 31), ("long", 63))


def narrowest(low, high) -> str:
    """The smallest integral type that holds [low, high]."""
    return next(t for t, bits in _WIDTHS if -(1 << bits) <= low and high < 1 << bits)


def compress_size(df: DataFrame, aggressiveness: int = 0, missing_name: str = "missing") -> DataFrame:
    """Categoricals filled and indexed, integers cast to the narrowest type, floats to float above level 0."""
    from tessera.operators.encode import to_indexes

    names = roles.categoricals(df)
    if names:
        df = to_indexes(df.na.fill(missing_name, names), names)
    whole = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    new = {}
    if whole:
        row = df.agg(*[f(c) for c in whole for f in (F.min, F.max)]).first()
        new = {c: F.col(c).cast(narrowest(row[2 * i] or 0, row[2 * i + 1] or 0)) for i, c in enumerate(whole)}
    if aggressiveness:
        new |= {c: F.col(c).cast("float") for c in df.columns if stats.is_floating(df, c)}
    return _with(df, new)


def add_noise(df: DataFrame, columns=None, level: float = 0.4, mode: str = "random", seed: int = 0) -> DataFrame:
    """`random`: x + x * level * (U - 1/2); `gaussian`: x + N(0, level)."""
    if mode not in ("random", "gaussian"):
        raise ValueError(f"unknown mode: {mode}")
    new = {}
    for i, c in enumerate(columns or roles.numericals(df)):
        x = F.col(c)
        new[c] = x + x * (F.rand(seed + i) * level - level / 2) if mode == "random" else x + F.randn(seed + i) * level
    return _with(df, new)


rm, rmnas, nas = remove, remove_nas, missing
