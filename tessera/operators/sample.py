"""Reproducible samples, splits and folds: rows are ordered by a seeded hash of their key."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import with_position


#: Leading bits of a hash that rows are counted by; one task adds up the counts.
DRAW_BITS = 20


def _draw(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The rows in an order that depends on key and seed alone."""
    return df.orderBy(_draw(key, seed), key)


def subsample(df: DataFrame, size: float, key: str, seed: int = 0, label: str | None = None) -> DataFrame:
    """Exactly `size` rows, or that share of the (labelled) rows; all of them if there are no more.

    They are those with the smallest hashes, unsigned: all below a cut that counts of leading bits give, and the first
    few rows at it. No row is sorted but those at the cut.
    """
    if size < 1:
        size = int(size * (df.count() if label is None else df.where(F.col(label).isNotNull()).count()))
    rows = df.withColumn("_h", F.shiftrightunsigned(_draw(key, seed), 64 - DRAW_BITS))
    counts = rows.groupBy("_h").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_h")))
    cut = upto.where(F.col("_upto") >= int(size)).agg(F.min(F.struct("_h", "_upto", "_n"))).first()[0]
    if cut is None:
        return df
    last = rows.where(F.col("_h") == cut["_h"]).orderBy(_draw(key, seed), key).limit(int(size) - (cut["_upto"] - cut["_n"]))
    return rows.where(F.col("_h") < cut["_h"]).unionByName(last).drop("_h")


def col_subsample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    names = random.Random(seed).sample(df.columns, max(1, int(fraction * len(df.columns))))
    return df.select(*[c for c in df.columns if c in names])


def split(df: DataFrame, key: str, train_fraction: float = 0.5, seed: int = 0, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first int(n * f) rows of the hash order, and int(n * (1 - f)) of the rest; by class if stratified.

    The cut is a value of the hash, found from counts of its leading bits, so nothing is sorted in one task.
    """
    ranked = _ranked(df, key, seed, stratify)
    cut, end = F.floor(F.col("_size") * train_fraction), F.floor(F.col("_size") * train_fraction) + F.floor(F.col("_size") * (1 - train_fraction))
    return ranked.where(F.col("_r") <= cut).select(*df.columns), ranked.where((F.col("_r") > cut) & (F.col("_r") <= end)).select(*df.columns)


def with_folds(df: DataFrame, k: int, key: str, seed: int = 0, output: str = "fold", stratify: str | None = None) -> DataFrame:
    """A fold of 0 to k - 1 by the hash of the key; if stratified, of every class as many rows in each, one apart at most."""
    if stratify is None:
        return df.withColumn(output, F.pmod(_draw(key, seed), F.lit(k)).cast("int"))
    ranked = _ranked(df, key, seed, stratify)
    return ranked.select(*df.columns, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int").alias(output))


def _ranked(df: DataFrame, key: str, seed: int, stratify: str | None) -> DataFrame:
    """df with `_r`, the 1-based rank by the hash of the key (of each class), and `_size`, the rows that are ranked."""
    groups = [stratify] if stratify else []
    rows = df.withColumn("_h", F.shiftrightunsigned(_draw(key, seed), 64 - DRAW_BITS))
    counts = rows.groupBy(*groups, "_h").agg(F.count("*").alias("_n"))
    total = Window.partitionBy(*groups)
    before = total.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_size", F.sum("_n").over(total)).drop("_n")
    inside = Window.partitionBy(*groups, "_h").orderBy(_draw(key, seed), key)
    if groups:
        rows, counts = rows.withColumn("_g", F.coalesce(F.col(stratify).cast("string"), F.lit(""))), counts.withColumn("_g", F.coalesce(F.col(stratify).cast("string"), F.lit(""))).drop(stratify)
    return rows.join(counts, ["_g", "_h"] if groups else ["_h"]).withColumn("_r", F.col("_before") + F.row_number().over(inside))


def label_folds(df: DataFrame, label: str, key: str, k: int = 3, output: str = "fold") -> DataFrame:
    """k blocks of whole labels, labels in the order of their first row; only distinct labels are ranked."""
    firsts = df.groupBy(F.col(label).alias("_l")).agg(F.min(key).alias("_first"))
    n = firsts.count()
    firsts = with_position(firsts, "_first", "_at")
    at = F.col("_at")
    size, more = n // k, n % k
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)))
    folds = firsts.select("_l", fold.cast("int").alias(output))
    return df.join(folds, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
