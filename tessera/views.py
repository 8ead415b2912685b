"""The driver's tables renamed to roles, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a view's columns are made, in SQL that Spark and DuckDB both read.
VIEWS = {
    "v_orders": "select o_orderkey as rid, o_orderstatus as c_status, o_orderpriority as c_priority, o_totalprice as n_total, o_orderdate as d_order from orders",
    "v_orders_seg": "select o_orderkey as rid, o_orderstatus as c_status, o_orderpriority as c_priority, o_totalprice as n_total, o_orderdate as d_order, c_mktsegment as c_segment, c_nationkey as i_nation from orders join customer on o_custkey = c_custkey",
    "v_orders_null": "select o_orderkey as rid, o_orderstatus as c_status, case when o_orderkey % 11 = 0 then null else o_orderpriority end as c_priority, case when o_orderkey % 7 = 0 then null else o_totalprice end as n_total from orders",
    "v_lineitem": "select l_returnflag as c_flag, l_linestatus as b_status, l_quantity as n_qty, l_extendedprice as n_price, l_discount as n_disc, l_tax as n_tax, l_shipdate as d_ship from lineitem",
    "v_part": "select p_partkey as rid, p_brand as c_brand, p_type as c_type, p_size as n_size, p_retailprice as n_retail from part",
    "v_events": "select event_id as rid, event_type as c_type, user_id as i_user, value as n_value, ts as d_ts from events",
    "v_docs": "select d.doc_id as rid, d.lang as c_lang, d.source as c_source, d.n_chars as n_chars, l.quality as b_quality, l.toxic as b_toxic from documents d join labels l on d.doc_id = l.doc_id",
    "v_texts": "select doc_id as rid, lang as c_lang, source as c_source, n_chars from documents",
    "v_preds": "select d.doc_id as rid, l.quality as y, cast((d.doc_id * 37) % 101 as double) / 101.0 as p1, cast((d.doc_id * 53) % 101 as double) / 101.0 as p2, cast((d.doc_id * 71) % 101 as double) / 101.0 as p3 from documents d join labels l on d.doc_id = l.doc_id",
}
_TABLES = ("orders", "customer", "lineitem", "part", "events", "documents", "labels", "supplier", "nation", "region", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role view; its tables are bound to the query, no name is registered."""
    import re

    text = VIEWS[name]
    used = [t for t in _TABLES if re.search(rf"(from|join) {t}\b", text)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(re.sub(r"(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], text), **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns}) if columns else df
