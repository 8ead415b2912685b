"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize

ROWS_PER_BUCKET = 2_000
#: Buckets that one task adds up, as a power of two; more are added up in groups first.
RUN_BITS = 12


def _before(counts: DataFrame, group: list[str], bucket: str, buckets: int) -> DataFrame:
    """counts (group, bucket, _n) with `_before`, the sum of _n of smaller buckets of the group."""
    if buckets <= 1 << RUN_BITS:
        before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    up = f"{bucket}_up"
    counts = counts.withColumn(up, F.shiftright(F.col(bucket).cast("long"), RUN_BITS))
    sums = _before(counts.groupBy(*group, up).agg(F.sum("_n").alias("_n")), group, up, -(-buckets >> RUN_BITS))
    before = Window.partitionBy(*group, up).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("_own", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    both = own.join(sums.select(*group, up, "_before"), [*group, up])
    return both.withColumn("_before", F.col("_before") + F.col("_own")).drop("_own", up)


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list, name: str, buckets: int) -> DataFrame:
    """0-based rank of each row in its group, in the order of (bucket, order), as column `name`.

    Ranks add up from counts per bucket, so no task gets more than a bucket's rows however large a group is, nor the
    counts of more than 2^RUN_BITS buckets.
    """
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    offsets = _before(counts, group, bucket, buckets).select(*group, bucket, "_before")
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    return (
        df.join(offsets, [*group, bucket])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before")
    )


def interleave_shards(rows: DataFrame, n_shards: int = 16, stratum: str = "stratum", key: str = "key") -> DataFrame:
    """Add `shard` and `slot` to rows: every shard holds each stratum in proportion, counts at most one apart.

    Rows are ranked by `key` (a seeded 64-bit hash) within their stratum, put in the order of (rank + 1/2) / size of
    the stratum, and that order is cut into n_shards runs. Each stratum's rows in a shard so differ from its share by
    about one. A null stratum is a stratum of its own; rows alike in every column may swap places; no rows give no
    rows. `rows` should be a written table: it is read several times.
    """
    extra = [c for c in rows.columns if c not in (stratum, key)]
    total = rows.count()
    buckets = max(16, -(-total // ROWS_PER_BUCKET))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    sizes = materialize(rows.groupBy("_s").agg(F.count("*").alias("_size")), "strata")
    own = F.ceil(F.col("_size") / ROWS_PER_BUCKET)
    rows = join_counted(rows, sizes, "_s", "_size", keep=True).withColumn("_b", F.floor(F.shiftrightunsigned(key, 24) / F.lit(float(1 << 40)) * own))
    # dealt by stratum and bucket: rows left where the join put them would give a hot stratum one task
    rows = rows.repartition("_s", "_b")
    ranked = _ranked(rows, ["_s"], "_b", [key, *extra], "_rank", buckets).drop("_b")
    ranked = ranked.withColumn("_part", (F.col("_rank") + F.lit(0.5)) / F.col("_size"))
    ranked = ranked.withColumn("_b", F.floor(F.col("_part") * buckets)).withColumn("_all", F.lit(0))
    placed = _ranked(ranked, ["_all"], "_b", ["_part", "_s", key, *extra], "_at", buckets)
    shard = F.floor(F.expr(f"(_at * {n_shards}) div {max(total, 1)}"))
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_at") - F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}"))
        .drop("_s", "_size", "_b", "_all", "_rank", "_part", "_at")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 17, source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, law, shard, slot, grown_shard of every document, by the law `rows`.

    A null text has size 1 and the checksum of no bytes; a null doc_id or source is a value like others. Only
    identifiers, sizes and checksums are shuffled; other columns of docs are not read.
    """
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.col(source).cast("string").alias("source"),
    )
    slim = slim.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    out = interleave_shards(materialize(slim, "shard-keys"), n_shards, "source", "_key")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
