"""Text formats of external learners: a line per row, as a column `line`, in the order of a key.

Zero values are skipped, and a feature gets its number when it is first seen, row by row and in a row column by column:
numericals, then categoricals, indexes and binaries. The numbers come from the first place of each feature, an aggregate
over features; rows are joined to them, never numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import roles
from tessera.operators.order import running_sum


def number_text(c: Column) -> Column:
    """A number as text: whole ones without a point, others without trailing zeros."""
    c = c.cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", c), "0+$", ""), r"\.$", "")
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(short)


def _cells(df: DataFrame, key: str, skip_zero: bool = True) -> DataFrame:
    """(key, pos, kind, feature, value) of every cell that is written."""
    numbers, others = roles.numericals(df), roles.categorical_like(df)
    parts = [F.struct(F.lit(i).alias("pos"), F.lit("n").alias("kind"), F.lit(c).alias("feature"), number_text(F.col(c)).alias("value"), (F.col(c) == 0).alias("zero")) for i, c in enumerate(numbers)]
    parts += [
        F.struct(F.lit(len(numbers) + i).alias("pos"), F.lit("c").alias("kind"), F.concat_ws("_", F.lit(c), F.col(c).cast("string")).alias("feature"), F.lit("1").alias("value"), (F.col(c).cast("string") == "0").alias("zero"))
        for i, c in enumerate(others)
    ]
    out = df.select(F.col(key).alias("_key"), F.explode(F.array(*parts)).alias("x")).select("_key", "x.*").where("value is not null")
    return out.where("not coalesce(zero, false)") if skip_zero else out


def feature_ids(cells: DataFrame, start: int = 0) -> DataFrame:
    firsts = cells.groupBy("feature").agg(F.min(F.struct("_key", "pos")).alias("_first"))
    placed = running_sum(firsts.select("feature", "_first.*"), "_key", F.lit(1), "id", ["pos"])
    return placed.select("feature", (F.col("id") + start).alias("id"))


def _lines(df: DataFrame, key: str, start: int) -> DataFrame:
    cells = _cells(df, key)
    return cells.join(feature_ids(cells, start), "feature")


def _finish(df: DataFrame, key: str, tokens: DataFrame, label: Column, extra: list[Column] | None = None) -> DataFrame:
    rows = df.select(F.col(key).alias("_key"), label.alias("_label"), *[c.alias(f"_e{i}") for i, c in enumerate(extra or [])])
    return rows.join(tokens, "_key", "left")


def _signed(y: str | None) -> Column:
    return F.lit("1.0") if y is None else F.when(F.col(y).isNull(), F.lit("1.0")).when(F.col(y) == 0, F.lit("-1.0")).otherwise(F.format_string("%.1f", F.col(y).cast("double")))


def _plain(y: str | None) -> Column:
    return F.lit("1.0") if y is None else F.coalesce(F.format_string("%.1f", F.col(y).cast("double")), F.lit("1.0"))


def _features(df: DataFrame, y, weights, key) -> DataFrame:
    return df.drop(*[c for c in (y, weights, key) if c])


def to_vw(df: DataFrame, key: str, y: str | None = None, weights: str | None = None) -> DataFrame:
    """(key, line): label [weight] ['tag] |n id:value ... |c id ...; label 0 is -1.0, a missing one 1.0."""
    cells = _lines(_features(df, y, weights, None).select(key, *[c for c in df.columns if c not in (y, weights, key)]), key, 0)
    some = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", F.concat_ws(":", "id", "value").alias("t") if kind == "n" else F.col("id").cast("string").alias("t")))))
    tokens = cells.groupBy("_key").agg(some("n").alias("_n"), some("c").alias("_c"))
    rows = _finish(df, key, tokens, _signed(y), [F.col(weights)] if weights else None)
    if weights:
        from tessera.operators.order import with_position

        rows = with_position(rows, "_key", "_tag")
        weight = F.when(F.col("_e0") != 1, F.concat(F.lit(" "), number_text(F.col("_e0")))).otherwise(F.lit(""))
        head = F.concat(F.col("_label"), weight, F.lit(" '"), F.col("_tag").cast("string"), F.lit(" |n"))
    else:
        head = F.concat(F.col("_label"), F.lit(" |n"))
    text = lambda c: F.concat_ws("", F.transform(F.col(c), lambda x: F.concat(F.lit(" "), x["t"])))
    category = F.when(F.size("_c") > 0, F.concat(F.lit(" |c"), text("_c"))).otherwise(F.lit(""))
    return rows.select(F.col("_key").alias(key), F.concat(head, F.coalesce(text("_n"), F.lit("")), F.coalesce(category, F.lit(""))).alias("line"))


def _flat(df: DataFrame, key: str, y, label: Column, start: int, by_id: bool) -> DataFrame:
    cells = _lines(df.select(key, *[c for c in df.columns if c not in (y, key)]), key, start)
    order = F.col("id") if by_id else F.col("pos")
    tokens = cells.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat_ws(":", "id", "value").alias("t")))).alias("_t"))
    rows = _finish(df, key, tokens, label)
    return rows.select(F.col("_key").alias(key), F.concat_ws(" ", "_label", F.transform("_t", lambda x: x["t"])).alias("line"))


def to_svmlight(df: DataFrame, key: str, y: str | None = None) -> DataFrame:
    """(key, line): numbers from 1, sorted; label 0 is -1.0."""
    return _flat(df, key, y, _signed(y), 1, True)


def to_libfm(df: DataFrame, key: str, y: str | None = None) -> DataFrame:
    """(key, line): numbers from 0, the label as it is."""
    return _flat(df, key, y, _plain(y), 0, False)


def to_libffm(df: DataFrame, key: str, y: str | None = None) -> DataFrame:
    """(key, line): whole label (0 if missing) and column:0:value of every numerical, zeros too."""
    names = [c for c in df.columns if c not in (y, key)]
    if roles.categorical_like(df.select(*names)):
        raise ValueError("categorical columns have no field-aware text here")
    label = F.lit("0") if y is None else F.coalesce(F.col(y).cast("long").cast("string"), F.lit("0"))
    cells = [F.concat_ws(":", F.lit(str(i)), F.lit("0"), number_text(F.col(c))) for i, c in enumerate(roles.numericals(df.select(*names)))]
    return df.select(key, F.concat_ws(" ", label, *cells).alias("line"))
