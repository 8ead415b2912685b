"""Row positions and trailing windows in a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values that cuts of keys without quantiles are taken from, for each bucket.
SAMPLE_EACH = 20


def cut_at(df: DataFrame, c: Column, cuts: list[float], output: str) -> DataFrame:
    """df with the number of the span between cuts that a number lies in, by binary search; null is -1, NaN comes last."""
    from pyspark.ml.feature import Bucketizer

    cuts = sorted({x + 0.0 for x in cuts if abs(x) < float("inf")})
    if not cuts:
        return df.withColumn(output, F.when(c.isNull(), F.lit(-1)).otherwise(F.lit(0)))
    # 0.0 makes one of both zeros, which a binary search would part
    placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_cut_x", outputCol="_cut_at", handleInvalid="keep").transform(df.withColumn("_cut_x", c.cast("double") + F.lit(0.0)))
    return placed.withColumn(output, F.when(F.col("_cut_x").isNull(), F.lit(-1)).otherwise(F.col("_cut_at").cast("int"))).drop("_cut_x", "_cut_at")


def _bucketed(df: DataFrame, key: str, n: int, output: str) -> DataFrame:
    """df with a number for each row that grows with the key: of n buckets of about as many rows. Null keys come first.

    Cuts are approximate quantiles of numbers and times, and of other keys the quantiles of a sample of at most
    n * SAMPLE_EACH distinct values with the smallest hashes.
    """
    kind = df.schema[key].dataType.typeName()
    c = F.col(f"`{key}`")
    if n <= 1:
        return df.withColumn(output, F.lit(0))
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal", "timestamp", "timestamp_ntz", "date"):
        c = F.unix_micros(c.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else c
        # a rounded number would part values that it can't tell apart, so numbers are compared as doubles
        c = c.cast("double")
        return cut_at(df, c, df.select(c.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n), output)
    some = [r[0] for r in df.select(c.alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(n * SAMPLE_EACH).collect()]
    some.sort(key=lambda v: v.encode() if isinstance(v, str) else v)
    cuts = list(dict.fromkeys(some[len(some) * i // n] for i in range(1, n))) if some else []
    below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < c)) if cuts else F.lit(0)
    return df.withColumn(output, F.when(c.isNull(), F.lit(-1)).otherwise(below))


def running_sum(df: DataFrame, by: str, value: Column, output: str, order: list | None = None, buckets: int | None = None, groups: list[str] | None = None, total: str | None = None) -> DataFrame:
    """df with the sum of `value` over all rows (of each group) before each one, in the order of `by`, then of `order`.

    Rows are cut into buckets of `by`; a bucket's sum counts for those after it, so a task holds a bucket's rows of a
    group, and the buckets' sums. Rows alike in `by` are in one bucket. `total` names the sum of the whole group.
    """
    n, groups = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups or []
    df = _bucketed(df, by, n, "_rs_bucket").withColumn("_rs_add", value)
    sums = df.groupBy(*[F.col(g).alias(f"_rs_g{i}") for i, g in enumerate(groups)], F.col("_rs_bucket").alias("_rs_edge")).agg(F.sum("_rs_add").alias("_rs_sum"))
    whole = Window.partitionBy(*[f"_rs_g{i}" for i in range(len(groups))])
    before = whole.orderBy("_rs_edge").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_rs_before", F.coalesce(F.sum("_rs_sum").over(before), F.lit(0))).withColumn(total or "_rs_total", F.sum("_rs_sum").over(whole))
    same = F.col("_rs_bucket") == F.col("_rs_edge")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_rs_g{i}"))
    inside = Window.partitionBy(*groups, "_rs_bucket").orderBy(F.col(f"`{by}`"), *(order or [])).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, same).withColumn(output, F.col("_rs_before") + F.coalesce(F.sum("_rs_add").over(inside), F.lit(0)))
    return out.drop("_rs_bucket", "_rs_edge", "_rs_sum", "_rs_before", "_rs_add", *([] if total else ["_rs_total"]), *[f"_rs_g{i}" for i in range(len(groups))])


def with_position(df: DataFrame, order_by: str, output: str = "_pos", buckets: int | None = None) -> DataFrame:
    """0-based position of each row in the order of a unique key of any type that can be ordered.

    A row's position is the number of rows in earlier buckets of the key and its place in its own, so tasks hold a
    bucket's rows each.
    """
    return running_sum(df, order_by, F.lit(1).cast("long"), output, buckets=buckets)


def _skew(c: Column, w) -> Column:
    n = F.count(c).over(w).cast("double")
    return F.skewness(c).over(w) * F.sqrt(n * (n - 1)) / (n - 2)


def _kurt(c: Column, w) -> Column:
    n = F.count(c).over(w).cast("double")
    return ((n + 1) * F.kurtosis(c).over(w) + 6) * (n - 1) / ((n - 2) * (n - 3))


ROLLING = {
    "sum": lambda c, w: F.sum(c).over(w),
    "mean": lambda c, w: F.avg(c).over(w),
    "median": lambda c, w: F.percentile(c, 0.5).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "std": lambda c, w: F.stddev_samp(c).over(w),
    "var": lambda c, w: F.var_samp(c).over(w),
    "count": lambda c, w: F.count(c).over(w),
    "skew": _skew,
    "kurt": _kurt,
}


def rolling(df: DataFrame, wanted: list[tuple[str, str, int, str]], order_by: str, chunk: int = 50_000) -> DataFrame:
    """Trailing windows: (function, column, size, output) each, null until the window is full of values.

    Rows are cut by position into chunks; each chunk gets copies of the rows before it that its windows reach, so every
    chunk is worked on by itself.
    """
    for name, *_ in wanted:
        if name not in ROLLING:
            raise ValueError(f"unsupported rolling function: {name}")
    reach = max(size for _, _, size, _ in wanted) - 1
    chunk = max(chunk, reach + 1)
    placed = with_position(df, order_by).withColumn("_chunk", F.floor(F.col("_pos") / chunk)).withColumn("_own", F.lit(True))
    tail = placed.where(F.pmod("_pos", F.lit(chunk)) >= chunk - reach).withColumn("_chunk", F.col("_chunk") + 1).withColumn("_own", F.lit(False))
    rows = placed.unionByName(tail) if reach else placed
    new = {}
    for name, column, size, output in wanted:
        w = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(-(size - 1), 0)
        c = F.col(column)
        new[output] = ROLLING[name](c, w) if name == "count" else F.when(F.count(c).over(w) == size, ROLLING[name](c.cast("double") if name in ("skew", "kurt") else c, w))
    return rows.withColumns(new).where("_own").drop("_own", "_chunk", "_pos")


def append_right(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Columns of both, row by row in the order of each side's key; names are made unique."""
    from tessera.roles import unique_names

    right_key = right_key or left_key
    names = unique_names(left.columns + [c for c in right.columns])
    a = with_position(left.toDF(*names[: len(left.columns)]), names[left.columns.index(left_key)])
    b = with_position(right.toDF(*names[len(left.columns) :]), names[len(left.columns) + right.columns.index(right_key)])
    return a.join(b, "_pos").drop("_pos")
