"""Comparisons of tables and of the values of their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles


def append_bottom(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of both, by name; a column that one lacks is null there."""
    return top.unionByName(bottom, allowMissingColumns=True)


def difference_with(left: DataFrame, right: DataFrame, column: str, right_column: str | None = None) -> DataFrame:
    """(value, side) of the distinct values that only one side has: 'left' or 'right'."""
    a = left.select(F.col(column).alias("value")).distinct()
    b = right.select(F.col(right_column or column).alias("value")).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def describe_similarity(left: DataFrame, right: DataFrame, columns=None) -> DataFrame:
    """(column, shared, only_left, pct_different, single_valued), the most different first."""
    names = columns or [c for c in roles.categorical_like(left) + roles.dates(left) if c in right.columns]

    def values(df, side):
        parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]
        return reduce(DataFrame.unionByName, parts).distinct().withColumn(side, F.lit(1))

    a, b = values(left, "l"), values(right, "r")
    both = a.join(b, (a["column"] == b["column"]) & a["value"].eqNullSafe(b["value"]), "left").select(a["column"], "l", "r")
    out = both.groupBy("column").agg(
        F.count("r").alias("shared"), (F.count("l") - F.count("r")).alias("only_left"),
        ((F.count("l") - F.count("r")) * 100.0 / F.count("l")).alias("pct_different"), (F.count("l") == 1).alias("single_valued"),
    )
    return out.orderBy(F.desc("pct_different"), "column")


def is_equal(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether both have the same columns, keys and values."""
    if left.columns != right.columns:
        return False
    return _compare(left, right, key, lambda a, b: a.eqNullSafe(b))


def all_close(left: DataFrame, right: DataFrame, key: str, tol: float = 1e-8, rtol: float = 1e-5) -> bool:
    """Whether values that share a key differ by at most tol + rtol * |right|."""
    return _compare(left, right, key, lambda a, b: F.coalesce(F.abs(a - b) <= tol + rtol * F.abs(b), a.isNull() & b.isNull()))


def _compare(left, right, key, same) -> bool:
    names = [c for c in left.columns if c != key]
    a = left.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(names)], F.lit(True).alias("_l"))
    b = right.select(F.col(key).alias("_k2"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(names)], F.lit(True).alias("_r"))
    test = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for i in range(len(names)):
        test = test & same(F.col(f"_a{i}"), F.col(f"_b{i}"))
    return a.join(b, F.col("_k").eqNullSafe(F.col("_k2")), "full").agg(F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True))).first()[0]


def hashcode(df: DataFrame, key: str | None = None) -> str:
    """A fingerprint of schema and rows, in any order; with a key, of the rows in the order of that (unique) column."""
    import hashlib

    from tessera.operators.order import with_position

    ordered = df.columns
    if key is not None:
        df, ordered = with_position(df, key, "_place"), [*df.columns, "_place"]
    cells = F.xxhash64(*ordered)
    row = df.agg(F.count("*"), F.bit_xor(cells), F.sum(cells.cast("decimal(38,0)"))).first()
    df = df.drop("_place") if key is not None else df
    return hashlib.sha1(repr((df.dtypes, tuple(row))).encode()).hexdigest()


def is_sparse(df: DataFrame, column: str) -> bool:
    """Whether the vectors of a column are sparse ones; a column of anything else, or of nulls, is not."""
    if df.schema[column].dataType.typeName() != "vectorudt":
        return False
    kinds = F.udf(lambda v: type(v).__name__ == "SparseVector", "boolean")
    row = df.where(F.col(column).isNotNull()).select(kinds(column)).first()
    return bool(row and row[0])


def nbytes(df: DataFrame) -> int:
    """Rows times the default width of their types."""
    return df.count() * sum(_width(f.dataType) for f in df.schema.fields)


def _width(kind) -> int:
    return {"byte": 1, "boolean": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "string": 20, "binary": 100}.get(kind.typeName(), 8)
