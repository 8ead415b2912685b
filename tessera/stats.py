"""Statistics of columns, all in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMED = ("mode", "mean", "median", "min", "max", "max+1", "iqm")


def finite(c: Column, floating: bool = True) -> Column:
    """c, null where it is not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if floating else c


def statistic(c: Column, name: str) -> Column:
    """The aggregate of a named statistic that needs no counts of values."""
    if name == "mean":
        return F.avg(c)
    if name == "min":
        return F.min(c)
    if name == "max":
        return F.max(c)
    if name == "max+1":
        return F.max(c) + 1
    raise ValueError(f"unknown statistic: {name}")


def is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))


#: Statistics that need a group's values in order or counted; `iqm` is the mid-hinge, the mean of the quartiles.
COUNTED = ("median", "iqm", "mode")


def _counts(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.where(F.col("_v").isNotNull()).groupBy(*groups, "_v").agg(F.count("*").alias("_n"))


#: Spans of values that quantiles are looked for in, at least; groups up to which their spans' facts are broadcast.
SPANS = 200
FEW_GROUPS = 1_000


@dataclass(frozen=True)
class Outline:
    """Cuts of a value into spans of about as many rows, and the number of groups, about, of each key."""

    cuts: list[float]
    sizes: list[int]


def outline(df: DataFrame, value: Column | None, keys: list[Column], more: list[Column] | None = None) -> tuple[Outline, list]:
    """The outline of a value (without one, no cuts) and some keys, and the values of further aggregates, in one pass."""
    spans = F.lit(None)
    if value is not None:
        n = max(SPANS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        x = value.cast("double")
        spans = F.percentile_approx(F.when(~F.isnan(x), x), [i / n for i in range(1, n)], 5 * n)
    cuts, *rest = df.agg(spans, *[F.approx_count_distinct(k) for k in keys], *(more or [])).first()
    return Outline(cuts or [], rest[: len(keys)]), rest[len(keys) :]


def quantiles(rows: DataFrame, shares: list[float], groups: list[str], known: Outline | None = None) -> DataFrame:
    """(groups, q0, q1, ...): exact quantiles of `_v`, between two values by their distance.

    Rows are counted by spans of values first; only the spans that the quantiles of a group lie in have their values
    counted and put in order, so most values are never shuffled, and no task holds more than a span of a group. Few
    groups' spans are broadcast and rows outside them dropped as they are read; those of many groups are joined with
    the counts. `known` is an outline of all rows, or of more than these, whose one size is that of the groups.
    """
    from tessera.operators.order import cut_at

    rows = rows.where(F.col("_v").isNotNull())
    known = known or outline(rows, F.col("_v"), [F.struct(*groups)] if groups else [])[0]
    rows = cut_at(rows, F.col("_v"), known.cuts, "_span")
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*groups, "_span").agg(F.count("*").alias("_n"))
    spans = spans.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_all", F.sum("_n").over(whole))

    def places(p: float) -> list[Column]:
        place = F.lit(p) * (F.col("_all") - 1)
        return [F.floor(place), F.ceil(place)]

    def holds(before: str, at: Column) -> Column:
        return (F.col(before) <= at) & (at < F.col(before) + F.col("_n"))

    asked = F.lit(False)
    for p in shares:
        for at in places(p):
            asked = asked | holds("_below", at)
    spans = spans.where(asked).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_span").alias("_s"), "_below", "_all")
    same = F.col("_span") == F.col("_s")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    by = [*groups, "_span", "_v"]
    if max(known.sizes, default=1) <= FEW_GROUPS:
        counts = rows.join(F.broadcast(spans), same).groupBy(*by, "_below", "_all").agg(F.count("*").alias("_n"))
    else:
        counts = rows.groupBy(*by).agg(F.count("*").alias("_n")).join(spans, same)
    inside = Window.partitionBy(*groups, "_span").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    aggs = []
    for i, p in enumerate(shares):
        for name, at in zip("lh", places(p)):
            aggs.append(F.max(F.when(holds("_before", at), F.col("_v").cast("double"))).alias(f"{name}{i}"))
        place = F.lit(p) * (F.col("_all") - 1)
        aggs.append(F.max(place - F.floor(place)).alias(f"w{i}"))
    found = placed.groupBy(*groups).agg(*aggs)
    return found.select(*groups, *[(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(shares))])


def modes(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, mode): the most frequent `_v`, of several the smallest."""
    return _counts(rows, groups).groupBy(*groups).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_v")).alias("_best")).select(*groups, F.col("_best._v").alias("mode"))


def _parts(rows: DataFrame, wanted: list[str], groups: list[str], known: Outline | None = None) -> list[tuple[DataFrame, dict[str, Column]]]:
    """Tables of one row a group, and the wanted statistics that each gives."""
    plain = [s for s in wanted if s not in COUNTED]
    out = [(rows.groupBy(*groups).agg(F.count("*").alias("_rows"), *[statistic(F.col("_v"), s).alias(f"p{i}") for i, s in enumerate(plain)]), {s: F.col(f"p{i}") for i, s in enumerate(plain)})]
    if {"median", "iqm"} & set(wanted):
        out.append((quantiles(rows, [0.25, 0.5, 0.75], groups, known), {"median": F.col("q1"), "iqm": (F.col("q0") + F.col("q2")) / 2}))
    if "mode" in wanted:
        out.append((modes(rows, groups), {"mode": F.col("mode")}))
    return out


def grouped(df: DataFrame, key: Column, value: Column, wanted: list[str], known: Outline | None = None) -> DataFrame:
    """(_k, _s0, _s1, ...): the wanted statistics of a value for each key that is not null."""
    (table, own), *more = _parts(df.select(key.alias("_k"), value.alias("_v")).where("_k is not null"), wanted, ["_k"], known)
    for part, names in more:
        table, own = table.join(part, "_k", "left"), own | names
    return table.select("_k", *[own[s].alias(f"_s{i}") for i, s in enumerate(wanted)])


def overall(df: DataFrame, value: Column, wanted: list[str], known: Outline | None = None) -> dict:
    """The wanted statistics of a value over all rows."""
    found = {}
    for part, names in _parts(df.select(value.alias("_v")), wanted, [], known):
        row = part.select(*[c.alias(f"s{i}") for i, c in enumerate(names.values())]).first() if names else ()
        found |= dict(zip(names, row or [None] * len(names)))
    return {s: found[s] for s in wanted}


def aggregates(df: DataFrame, wanted: dict[str, str]) -> dict:
    """{column: value of its statistic}; infinities and NaN do not count.

    Plain statistics of all columns are one job; a median, mid-hinge or mode is one of its own for each column.
    """
    values = {c: finite(F.col(f"`{c}`"), is_floating(df, c)) for c in wanted}
    plain = [c for c, s in wanted.items() if s not in COUNTED]
    row = df.agg(*[statistic(values[c], wanted[c]).alias(f"s{i}") for i, c in enumerate(plain)]).first() if plain else ()
    found = dict(zip(plain, row))
    return {c: found[c] if c in found else overall(df, values[c], [s])[s] for c, s in wanted.items()}


def sigma_limits(df: DataFrame, column: str, sigma: float = 3) -> tuple[float | None, float | None]:
    """Mean less and plus sigma deviations; of one value that value, of none (None, None)."""
    c = F.col(f"`{column}`")
    row = df.agg(F.avg(c), F.stddev_samp(c)).first()
    if row[0] is None:
        return None, None
    spread = sigma * (row[1] or 0.0)
    return row[0] - spread, row[0] + spread
