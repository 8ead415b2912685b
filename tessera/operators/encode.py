"""Encodings of categorical columns: codes, counts, shares, target statistics, rare values, bins.

A column's statistics are an aggregate over its values, joined back; Spark broadcasts that side where its measured size
allows and shuffles it otherwise. Rows are never sorted or windowed by a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import roles, stats
from tessera.operators.order import running_sum, with_position


def _lookup(df: DataFrame, column: str, table: DataFrame, key: str = "_k") -> DataFrame:
    """df left-joined to a table keyed by the column's values; null values match nothing."""
    return df.join(table, F.col(f"`{column}`") == F.col(key), "left").drop(key)


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("_n"))


def to_indexes(df: DataFrame, columns=None, drop: bool = True) -> DataFrame:
    """i_<c>: codes from 0 in the order of the values, null is -1. Only distinct values are ranked."""
    names = columns or roles.categoricals(df) + roles.binaries(df)
    for c in names:
        values = df.select(F.col(c).alias("_k")).where("_k is not null").distinct()
        codes = with_position(values, "_k", "_code").withColumn("_code", F.col("_code").cast("int"))
        name = "i_" + (c[2:] if roles.is_valid_name(c) else c) if drop else "i_" + c
        df = _lookup(df, c, codes).withColumn(name, F.coalesce("_code", F.lit(-1))).drop("_code")
    return df.drop(*names) if drop else df


#: Values of a column that one_hot_encode makes columns of.
MAX_HOT = 2_000


def one_hot_encode(df: DataFrame, columns=None, prefix: str = "oh") -> DataFrame:
    """A 0/1 column per value (ascending) of each encoded column, named <prefix>_<c>_<k>, then the others.

    Columns of more than MAX_HOT values are refused; `one_hot_vector` takes any number.
    """
    names = columns or roles.categorical_like(df)
    if not names:
        return df
    sizes = df.agg(*[F.approx_count_distinct(c, 0.02) for c in names]).first()
    if over := [c for c, n in zip(names, sizes) if n > MAX_HOT]:
        raise ValueError(f"more than {MAX_HOT} values in {', '.join(over)}: use one_hot_vector")
    row = df.agg(*[F.array_sort(F.collect_set(c)) for c in names]).first()
    hot = [F.coalesce((F.col(c) == F.lit(v)), F.lit(False)).cast("double").alias(f"{prefix}_{c}_{k}") for c, values in zip(names, row) for k, v in enumerate(values)]
    return df.select(*hot, *[c for c in df.columns if c not in names])


def one_hot_vector(df: DataFrame, columns=None, output: str = "features") -> DataFrame:
    """One-hot columns and numericals as one sparse vector, for columns of many values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    names = columns or roles.categorical_like(df)
    numbers = roles.numericals(df)
    indexed, hot = [f"_ix_{c}" for c in names], [f"_oh_{c}" for c in names]
    steps = [
        StringIndexer(inputCols=names, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=hot + numbers, outputCol=output, handleInvalid="keep"),
    ]
    return Pipeline(stages=steps).fit(df).transform(df).drop(*indexed, *hot)


def cats_to_count_of_samples(df: DataFrame, columns=None) -> DataFrame:
    for c in columns or roles.categorical_like(df):
        df = _lookup(df, c, _counts(df, c)).withColumn(c, F.col("_n")).drop("_n")
    return df


def cats_to_ratio_of_samples(df: DataFrame, columns=None) -> DataFrame:
    total = df.count()
    for c in columns or roles.categorical_like(df):
        df = _lookup(df, c, _counts(df, c)).withColumn(c, F.col("_n") / F.lit(total)).drop("_n")
    return df


def _positive(df: DataFrame, y: str, positive_class):
    row = df.where(F.col(y).isNotNull()).agg(F.min(y), F.max(y), F.count_distinct(y)).first()
    if row[2] != 2:
        raise ValueError(f"{y} has {row[2]} classes, not two")
    return row[1] if positive_class is None else positive_class


def cats_to_count_of_binary_target(df: DataFrame, y: str, columns=None, positive_class=None) -> DataFrame:
    """Each value becomes the number of rows of it with the positive (by default, the larger) class."""
    positive = _positive(df, y, positive_class)
    for c in columns or [c for c in roles.categorical_like(df) if c != y]:
        table = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k")).agg(F.count_if(F.col(y) == F.lit(positive)).alias("_n"))
        df = _lookup(df, c, table).withColumn(c, F.col("_n")).drop("_n")
    return df


def cats_to_ratio_of_binary_target(df: DataFrame, y: str, columns=None, positive_class=None) -> DataFrame:
    positive = _positive(df, y, positive_class)
    for c in columns or [c for c in roles.categorical_like(df) if c != y]:
        share = F.count_if(F.col(y) == F.lit(positive)) / F.count(y)
        table = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k")).agg(share.alias("_n"))
        df = _lookup(df, c, table).withColumn(c, F.col("_n")).drop("_n")
    return df


ALL_STATS = ("mean", "iqm", "median", "min", "max")


def cats_to_stat(df: DataFrame, y: str, stat="mean", remove_originals: bool = True, columns=None, missing_value="missing", missing_treatment: str = "missing-category", noise_level: float = 0, seed: int = 0) -> DataFrame:
    """n_<c>_<stat>: the target's statistic among the labelled rows of each value, stat by stat.

    Rows without a label get the values of those with one. A value that no labelled row has takes that of
    `missing_value` if the treatment is 'missing-category' and labelled rows have that, else the statistic of all.
    """
    names = columns or [c for c in roles.categorical_like(df) if c != y]
    per = {c: stat[c] if isinstance(stat, dict) else stat for c in names}
    per = {c: list(ALL_STATS) if s == "all" else [s] if isinstance(s, str) else list(s) for c, s in per.items()}
    used = list(dict.fromkeys(s for v in per.values() for s in v))
    train = df.where(F.col(y).isNotNull())
    keys = {c: F.coalesce(F.col(c).cast("string"), F.lit(missing_value)) for c in names}
    ordered = F.col(y) if {"median", "iqm"} & set(used) else None
    known, gaps = stats.outline(train, ordered, [*keys.values()], [F.count_if(k == F.lit(missing_value)) for k in keys.values()])
    overall = stats.overall(train, F.col(y), used, stats.Outline(known.cuts, []))
    for n, (c, key) in enumerate(keys.items()):
        table = stats.grouped(train, key, F.col(y), per[c], stats.Outline(known.cuts, [known.sizes[n]]))
        default = dict(overall)
        if missing_treatment == "missing-category" and gaps[n] and (own := table.where(F.col("_k") == missing_value).first()):
            default |= {s: own[f"_s{i}"] for i, s in enumerate(per[c])}
        # rows are never shuffled by a key of few values, which would leave them to as few tasks
        table = F.broadcast(table) if known.sizes[n] <= stats.FEW_GROUPS else table
        df = df.join(table, key == F.col("_k"), "left").drop("_k")
        for i, s in enumerate(per[c]):
            value = F.coalesce(F.col(f"_s{i}").cast("double"), F.lit(default[s]).cast("double"))
            if noise_level:
                value = value + F.randn(seed + 97 * n + i) * noise_level
            df = df.withColumn(f"n_{c}_{s}", value).drop(f"_s{i}")
    made = [f"n_{c}_{s}" for s in used for c in names if s in per[c]]
    rest = [c for c in df.columns if c not in made and not (remove_originals and c in names)]
    return df.select(*rest, *made)


def group_rare(df: DataFrame, columns=None, limit: int | None = None, top_x: int | None = None, rare_val=None) -> DataFrame:
    """Values with at most `limit` rows, or all but the `top_x` most frequent, become one rare value; nulls stay.

    The rare value is 'rare', -1 in numerical columns, one more than the largest in index columns. Ties go by value.
    """
    if (limit is None) == (top_x is None):
        raise ValueError("give either limit or top_x")
    for c in columns or roles.categorical_like(df):
        counts = _counts(df, c)
        if limit is not None:
            rare = counts.where(F.col("_n") <= limit).select("_k", F.lit(True).alias("_rare"))
        else:
            common = [r["_k"] for r in counts.orderBy(F.desc("_n"), "_k").limit(top_x).select("_k").collect()]
            rare = counts.where(~F.col("_k").isin(common)).select("_k", F.lit(True).alias("_rare"))
        value = rare_val
        if value is None:
            largest = df.agg(F.max(c)).first()[0] if c.startswith("i_") else None
            value = -1 if c.startswith("n_") else "rare" if not c.startswith("i_") else 0 if largest is None else largest + 1
        df = _lookup(df, c, rare).withColumn(c, F.when(F.col("_rare"), F.lit(value)).otherwise(F.col(c))).drop("_rare")
    return df


def categorical_outliers(df: DataFrame, columns=None, min_size: float = 0.01, fill_mode: str = "mode") -> DataFrame:
    """Values of at most `min_size` rows (a share of all, if a fraction) become the mode, or the constant given."""
    names = columns or roles.categorical_like(df)
    least = df.count() * min_size if isinstance(min_size, float) else min_size
    for c in names:
        mode = stats.overall(df, F.col(c), ["mode"])["mode"] if fill_mode == "mode" else None
        rare = _counts(df, c).where(F.col("_n") <= F.lit(least)).select("_k", F.lit(True).alias("_rare"))
        df = _lookup(df, c, rare).withColumn(c, F.when(F.col("_rare"), F.lit(mode if fill_mode == "mode" else fill_mode)).otherwise(F.col(c))).drop("_rare")
    return df


def bin_edges(low: float, high: float, n_bins: int) -> list[float]:
    """Right-closed bins of equal width, the lowest edge lower by a thousandth of the range."""
    width = (high - low) / n_bins
    return [low - (high - low) * 0.001] + [low + width * k for k in range(1, n_bins)] + [high]


def bin_index(x: Column, low: Column, high: Column, n_bins: int) -> Column:
    """0-based number of the right-closed bin of equal width."""
    at = F.ceil(F.try_divide((x - low) * n_bins, high - low)) - 1
    return F.when(x.isNotNull(), F.greatest(F.coalesce(at, F.lit(0)), F.lit(0))).cast("int")


def bin_columns(df: DataFrame, columns=None, n_bins: int = 10, drop: bool = False, labels: bool = True) -> DataFrame:
    """c_binned_<n>: the label '(lo, hi]' of the bin, or its number; null where the column has no value."""
    names = columns or roles.numericals(df)
    row = df.agg(*[f(c) for c in names for f in (F.min, F.max)]).first()
    new = {}
    for i, c in enumerate(names):
        if row[2 * i] is None:
            new["c_binned_" + c] = F.lit(None).cast("string" if labels else "int")
            continue
        low, high = float(row[2 * i]), float(row[2 * i + 1])
        at = bin_index(F.col(c).cast("double"), F.lit(low), F.lit(high), n_bins)
        if labels:
            e = [f"{x:.3f}".rstrip("0").rstrip(".") for x in bin_edges(low, high, n_bins)]
            at = F.element_at(F.array(*[F.lit(f"({a}, {b}]") for a, b in zip(e, e[1:])]), at + 1)
        new["c_binned_" + c] = at
    df = df.withColumns(new)
    return df.drop(*names) if drop else df


def to_rank(df: DataFrame, column: str, output: str = "rank", normalise: bool = True) -> DataFrame:
    """Average rank (ties share the mean of their places), optionally mapped to 0..1.

    Ranks add up over the distinct values, which are counted first; only those are sorted.
    """
    counts = _counts(df, column)
    ranked = running_sum(counts, "_k", F.col("_n"), "_below").select("_k", (F.col("_below") + (F.col("_n") + 1) / 2).alias("_rank"))
    if normalise:
        low, high = ranked.agg(F.min("_rank"), F.max("_rank")).first()
        ranked = ranked.withColumn("_rank", F.try_divide(F.col("_rank") - F.lit(low), F.lit(high) - F.lit(low)))
    return _lookup(df, column, ranked).withColumnRenamed("_rank", output)


def impute_categorical(df: DataFrame, column: str, missing_value=None, features=None) -> DataFrame:
    """Fill a categorical column's missing values by a logistic regression on the other columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer

    gap = F.col(column).isNull() if missing_value is None else F.col(column) == missing_value
    others = features or [c for c in roles.categorical_like(df) if c != column]
    whole = df.na.fill(0, roles.numericals(df))
    ready = one_hot_vector(whole.na.fill("missing", [c for c in others if df.schema[c].dataType.typeName() == "string"]), others, "_x")
    indexer = StringIndexer(inputCol=column, outputCol="_y", handleInvalid="keep").fit(ready.where(~gap))
    model = Pipeline(stages=[LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=50)]).fit(indexer.transform(ready.where(~gap)))
    named = IndexToString(inputCol="_p", outputCol="_name", labels=indexer.labels).transform(model.transform(ready))
    return named.withColumn(column, F.when(gap, F.col("_name")).otherwise(F.col(column))).select(*df.columns)


ohe, toidxs = one_hot_encode, to_indexes
