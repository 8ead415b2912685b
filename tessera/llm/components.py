"""Connected components of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`, the component being its smallest node.

    Alternating large-star and small-star steps on a table of links, each step written to the shared folder. A node's
    smallest neighbour is an aggregate that is combined map-side, and goes to the links of nodes with very many of them
    by broadcast, so such a node is no hot task. Self links and repeated links are allowed.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = links.where("u = v").select("u")
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = materialize(links, "links")
    links, before = nodes, None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        least = materialize(least.where("n > 0"), "least-neighbours")
        # large star: neighbours above a node are linked to its smallest
        links = join_counted(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(links.where("u <> v").distinct(), "large-star")
        # small star: neighbours below a node are linked to the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u")
        links = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        links = links.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct()
        links = materialize(links, "small-star")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    found = found.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")))
    return found.groupBy("node").agg(F.min("component").alias("component"))
