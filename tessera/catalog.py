"""Query name -> builder and oracle SQL. Doubles are rounded on both sides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles
from tessera.functions import dates, scalar
from tessera.ml import ensemble, features, folds, learners
from tessera.operators import clean, encode, evaluate, order, profile, rows, sample, serialize, sets
from tessera.plans.dsl import engineer
from tessera.views import VIEWS, rounded, table, view

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _with(view_names: str, body: str) -> str:
    return "with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in view_names.split()) + " " + body


def query(name: str, sql: str | None = None, views: str = ""):
    def keep(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = _with(views, sql) if views else sql
        return fn

    return keep


def over(name: str, view_name: str, fn, sql: str | None = None) -> None:
    """A query of one view."""
    query(name, sql, view_name)(lambda spark, sf, fn=fn, v=view_name: fn(view(spark, sf, v)))


# imputation
_NULLS = "v_orders_null"
_FILLS = {
    "mean": "avg(n_total)", "median": "median(n_total)", "min": "min(n_total)", "max": "max(n_total)", "max_plus1": "max(n_total) + 1",
    "iqm": "(quantile_cont(n_total, 0.25) + quantile_cont(n_total, 0.75)) / 2",
}
for _k, _e in _FILLS.items():
    over(
        f"missing_{_k}", _NULLS, lambda df, k=_k: rounded(clean.missing(df, "none", k.replace("_plus", "+")), "n_total"),
        f"select rid, c_status, c_priority, round(coalesce(n_total, (select {_e} from v_orders_null)), 6) as n_total from v_orders_null",
    )
over(
    "missing_mode", _NULLS, lambda df: clean.missing(df, "mode", "mode").select("rid", "c_priority", F.round("n_total", 6).alias("n_total")),
    """select rid, coalesce(c_priority, (select c_priority from v_orders_null where c_priority is not null group by 1 order by count(*) desc, 1 limit 1)) as c_priority,
    round(coalesce(n_total, (select n_total from v_orders_null where n_total is not null group by 1 order by count(*) desc, 1 limit 1)), 6) as n_total from v_orders_null""",
)
over("missing_constant", _NULLS, lambda df: clean.missing(df, "na", -10).select("rid", "c_priority", "n_total"), "select rid, coalesce(c_priority, 'na') as c_priority, coalesce(n_total, -10.0) as n_total from v_orders_null")
over("remove_nas", _NULLS, lambda df: clean.remove_nas(df), "select * from v_orders_null where c_priority is not null and n_total is not null")
over("remove_nas_subset", _NULLS, lambda df: clean.remove_nas(df, "n_total"), "select * from v_orders_null where n_total is not null")
over("remove_null_threshold", _NULLS, lambda df: clean.remove(df, missing_threshold=0.1), "select rid, c_status, c_priority from v_orders_null")
over("remove_roles", "v_orders", lambda df: clean.remove(df, categoricals=True, dates=True), "select rid, n_total from v_orders")
over("trim_on_y", "v_orders", lambda df: clean.trim_on_y(df, "n_total", 50000, 150000).select("rid", "n_total"), "select rid, n_total from v_orders where n_total between 50000 and 150000")
over("split_train_test", _NULLS, lambda df: (lambda p: p[0].select("rid", F.lit("train").alias("part")).unionByName(p[1].select("rid", F.lit("test").alias("part"))))(clean.split_train_test(df, "n_total")), "select rid, case when n_total is null then 'test' else 'train' end as part from v_orders_null")
# scaling
_ST = "(select avg(n_total) m, stddev_samp(n_total) s, min(n_total) lo, max(n_total) hi from v_orders) st"
over("scale_zscore", "v_orders", lambda df: rounded(clean.scale(df).select("rid", "n_total"), "n_total"), f"select rid, round((n_total - m) / s, 6) as n_total from v_orders, {_ST}")
over("scale_minmax", "v_orders", lambda df: rounded(clean.scale(df, min_max=(10, 20)).select("rid", "n_total"), "n_total"), f"select rid, round((n_total - lo) / (hi - lo) * 10 + 10, 6) as n_total from v_orders, {_ST}")
over("normalise", "v_orders", lambda df: rounded(clean.normalise(df).select("rid", "n_total"), "n_total"), f"select rid, round((n_total - lo) / (hi - lo), 6) as n_total from v_orders, {_ST}")
over("outliers_clip", "v_orders", lambda df: rounded(clean.outliers(df, 1).select("rid", "n_total"), "n_total", digits=4), f"select rid, round(least(greatest(n_total, m - s), m + s), 4) as n_total from v_orders, {_ST}")


@query("sigma_limits", "select round(avg(n_total) - 2 * stddev_samp(n_total), 4) as low, round(avg(n_total) + 2 * stddev_samp(n_total), 4) as high from v_orders", "v_orders")
def _sigma(spark, sf):
    from tessera.stats import sigma_limits

    low, high = sigma_limits(view(spark, sf, "v_orders"), "n_total", 2)
    return rounded(spark.createDataFrame([(low, high)], "low double, high double"), "low", "high", digits=4)


over("floats_to_ints", "v_part", lambda df: clean.floats_to_ints(df.select("rid", "n_retail"), 2), "select rid, cast(trunc(n_retail * 100) as bigint) as n_retail from v_part")
over("min_y_floor", "v_orders", lambda df: clean.floor_at(df.select("rid", "n_total"), "n_total", 100000.0), "select rid, greatest(n_total, 100000.0) as n_total from v_orders")
over("compress_size", "v_part", lambda df: spark_types(clean.compress_size(df.drop("c_brand", "c_type"), 1)), "select * from (values ('rid', 'smallint', {n}), ('n_size', 'tinyint', {n}), ('n_retail', 'float', {n})) t(column_name, kind, n)".replace("{n}", "(select count(*) from v_part)"))


over("compress_values", "v_part", lambda df: clean.compress_size(df.select("rid", "n_size", "n_retail"), 1).select(F.col("rid").cast("long").alias("rid"), F.col("n_size").cast("long").alias("n_size"), F.round(F.col("n_retail").cast("double"), 2).alias("n_retail")), "select rid, n_size::bigint as n_size, round(n_retail::float::double, 2) as n_retail from v_part")


def spark_types(df: DataFrame) -> DataFrame:
    """(column_name, kind, n): a table's types and rows."""
    n = df.count()
    return df.sparkSession.createDataFrame([(c, t, n) for c, t in df.dtypes], "column_name string, kind string, n long")


# encoders
over("to_indexes", "v_part", lambda df: encode.to_indexes(df.select("rid", "c_brand", "c_type")), "select rid, dense_rank() over (order by c_brand) - 1 as i_brand, dense_rank() over (order by c_type) - 1 as i_type from v_part")
over("to_indexes_null", _NULLS, lambda df: encode.to_indexes(df.select("rid", "c_priority"), ["c_priority"]), "select rid, case when c_priority is null then -1 else dense_rank() over (order by c_priority nulls last) - 1 end as i_priority from v_orders_null")
over(
    "one_hot", "v_lineitem", lambda df: encode.one_hot_encode(df.select("c_flag", "b_status", "n_qty")).groupBy().agg(*[F.sum(c).alias(c) for c in ("oh_c_flag_0", "oh_c_flag_1", "oh_c_flag_2", "oh_b_status_0", "oh_b_status_1", "n_qty")]),
    "select sum((c_flag = 'A')::int)::double as oh_c_flag_0, sum((c_flag = 'N')::int)::double as oh_c_flag_1, sum((c_flag = 'R')::int)::double as oh_c_flag_2, sum((b_status = 'F')::int)::double as oh_b_status_0, sum((b_status = 'O')::int)::double as oh_b_status_1, sum(n_qty) as n_qty from v_lineitem",
)
over("one_hot_rows", "v_part", lambda df: encode.one_hot_encode(df.select("rid", "c_brand")).select("rid", "oh_c_brand_0", "oh_c_brand_3"), "select rid, (r = 1)::int::double as oh_c_brand_0, (r = 4)::int::double as oh_c_brand_3 from (select p_partkey as rid, dense_rank() over (order by p_brand) as r from part) t")
_EDGE = "rtrim(rtrim(printf('%.3f', {}), '0'), '.')"
over(
    "bin_labels", "v_part", lambda df: encode.bin_columns(df.select("rid", "n_size"), n_bins=7, drop=True),
    f"""select rid, '(' || {_EDGE.format("case when k = 0 then lo - (hi - lo) * 0.001::double else lo + (hi - lo) / 7 * k end")} || ', ' || {_EDGE.format("case when k = 6 then hi else lo + (hi - lo) / 7 * (k + 1) end")} || ']' as c_binned_n_size
    from (select rid, lo, hi, greatest(ceil((n_size - lo) * 7 / (hi - lo)) - 1, 0) as k from v_part, (select min(n_size)::double as lo, max(n_size)::double as hi from v_part) s) t""",
)
over("bin_equal_width", "v_part", lambda df: encode.bin_columns(df.select("rid", "n_retail"), n_bins=7, labels=False, drop=True), "select rid, cast(greatest(ceil((n_retail - lo) * 7 / (hi - lo)) - 1, 0) as int) as c_binned_n_retail from v_part, (select min(n_retail) lo, max(n_retail) hi from v_part) s")
over("group_rare_limit", "v_texts", lambda df: encode.group_rare(df.select("rid", "c_source", "c_lang"), ["c_lang"], limit=130), "select rid, c_source, case when count(*) over (partition by c_lang) <= 130 then 'rare' else c_lang end as c_lang from v_texts")
over("group_rare_topx", "v_part", lambda df: encode.group_rare(df.select("rid", "c_brand"), top_x=10), "select rid, case when c_brand in (select c_brand from v_part group by 1 order by count(*) desc, c_brand limit 10) then c_brand else 'rare' end as c_brand from v_part")
over("categorical_outliers_const", "v_texts", lambda df: encode.categorical_outliers(df.select("rid", "c_lang"), min_size=0.13, fill_mode="others"), "select rid, case when count(*) over (partition by c_lang) <= 0.13 * count(*) over () then 'others' else c_lang end as c_lang from v_texts")
over("categorical_outliers_mode", "v_texts", lambda df: encode.categorical_outliers(df.select("rid", "c_lang"), min_size=0.13), "select rid, case when count(*) over (partition by c_lang) <= 0.13 * count(*) over () then (select c_lang from v_texts group by 1 order by count(*) desc, 1 limit 1) else c_lang end as c_lang from v_texts")
over("count_of_samples", "v_texts", lambda df: encode.cats_to_count_of_samples(df.select("rid", "c_lang", "c_source")), "select rid, count(*) over (partition by c_lang) as c_lang, count(*) over (partition by c_source) as c_source from v_texts")
over("ratio_of_samples", "v_texts", lambda df: rounded(encode.cats_to_ratio_of_samples(df.select("rid", "c_lang")), "c_lang"), "select rid, round(count(*) over (partition by c_lang) / (count(*) over ())::double, 6) as c_lang from v_texts")
over("count_binary_target", "v_docs", lambda df: encode.cats_to_count_of_binary_target(df.select("rid", "c_lang", "b_quality"), "b_quality"), "select rid, b_quality, (sum((b_quality = 1)::int) over (partition by c_lang))::bigint as c_lang from v_docs")
over("ratio_binary_target", "v_docs", lambda df: rounded(encode.cats_to_ratio_of_binary_target(df.select("rid", "c_lang", "b_quality"), "b_quality"), "c_lang"), "select rid, b_quality, round(avg((b_quality = 1)::int) over (partition by c_lang), 6) as c_lang from v_docs")
_STATS = {"mean": "avg(n_total)", "median": "median(n_total)", "min": "min(n_total)", "max": "max(n_total)", "iqm": "(quantile_cont(n_total, 0.25) + quantile_cont(n_total, 0.75)) / 2"}
for _k, _e in _STATS.items():
    over(
        f"stat_{_k}", "v_orders_seg", lambda df, k=_k: rounded(encode.cats_to_stat(df.select("rid", "c_segment", "n_total"), "n_total", k), f"n_c_segment_{k}", digits=4),
        f"select rid, n_total, round(s, 4) as n_c_segment_{_k} from v_orders_seg join (select c_segment, {_e} as s from v_orders_seg group by 1) t using (c_segment)",
    )
over(
    "stat_all", "v_orders_seg", lambda df: rounded(encode.cats_to_stat(df.select("rid", "c_segment", "c_status", "n_total"), "n_total", "all").drop("n_total"), *[f"n_{c}_{s}" for s in encode.ALL_STATS for c in ("c_segment", "c_status")], digits=4),
    "select rid, " + ", ".join(f"round({a}.{s}, 4) as n_{c}_{s}" for s in encode.ALL_STATS for a, c in (("a", "c_segment"), ("b", "c_status")))
    + " from v_orders_seg " + " ".join(f"join (select {c}, " + ", ".join(f"{e} as {s}" for s, e in _STATS.items()) + f" from v_orders_seg group by 1) {a} using ({c})" for a, c in (("a", "c_segment"), ("b", "c_status"))),
)
over(
    "stat_unseen_test", "v_orders_seg", lambda df: rounded(encode.cats_to_stat(df.select("rid", F.concat("c_segment", F.when(F.col("rid") % 5 == 0, F.lit("!")).otherwise("")).alias("c_seg"), F.when(F.col("rid") % 5 != 0, F.col("n_total")).alias("y")), "y").select("rid", "n_c_seg_mean"), "n_c_seg_mean", digits=4),
    "select rid, round(case when rid % 5 = 0 then (select avg(n_total) from v_orders_seg where rid % 5 <> 0) else avg(case when rid % 5 <> 0 then n_total end) over (partition by c_segment) end, 4) as n_c_seg_mean from v_orders_seg",
)
over("to_rank", "v_part", lambda df: encode.to_rank(df.select("rid", "n_size"), "n_size", "rank", False), "select rid, n_size, rank() over (order by n_size) + (count(*) over (partition by n_size) - 1) / 2.0 as rank from v_part")
over("to_rank_normalised", "v_part", lambda df: rounded(encode.to_rank(df.select("rid", "n_size"), "n_size"), "rank"), "select rid, n_size, round((r - min(r) over ()) / (max(r) over () - min(r) over ()), 6) as rank from (select rid, n_size, rank() over (order by n_size) + (count(*) over (partition by n_size) - 1) / 2.0 as r from v_part) t")
# rolling windows
_SEAMS = 1_500  # rows of a chunk, so that windows cross chunks at every scale
_ROLL = {"sum": "sum(n_value)", "mean": "avg(n_value)", "median": "median(n_value)", "min": "min(n_value)", "max": "max(n_value)", "std": "stddev_samp(n_value)"}
for _k, _e in _ROLL.items():
    over(
        f"rolling_{_k}", "v_events", lambda df, k=_k: rounded(order.rolling(df.select("rid", "n_value"), [(k, "n_value", 5, "r")], "rid", _SEAMS).select("rid", "r"), "r", digits=4),
        f"select rid, round(case when count(n_value) over w = 5 then {_e} over w end, 4) as r from v_events window w as (order by rid rows between 4 preceding and current row)",
    )
# of five whole numbers, 20 times the variance is whole: no ties in rounding it
over("rolling_var", "v_events", lambda df: rounded(order.rolling(df.select("rid", F.round(F.col("n_value") * 100).alias("n_cents")), [("var", "n_cents", 5, "r")], "rid", _SEAMS).select("rid", (F.col("r") * 20).alias("r")), "r", digits=0), "select rid, round(case when count(n_value) over w = 5 then var_samp(round(n_value * 100)) over w end * 20, 0) as r from v_events window w as (order by rid rows between 4 preceding and current row)")
over("rolling_count", "v_events", lambda df: order.rolling(df.select("rid", "n_value"), [("count", "n_value", 5, "r")], "rid", _SEAMS).select("rid", "r"), "select rid, count(n_value) over (order by rid rows between 4 preceding and current row) as r from v_events")
over("rolling_skew", "v_events", lambda df: rounded(order.rolling(df.select("rid", "n_value"), [("skew", "n_value", 12, "r")], "rid", _SEAMS).select("rid", "r"), "r", digits=4), "select rid, round(case when count(n_value) over w = 12 then skewness(n_value) over w end, 4) as r from v_events window w as (order by rid rows between 11 preceding and current row)")
over("rolling_kurt", "v_events", lambda df: rounded(order.rolling(df.select("rid", "n_value"), [("kurt", "n_value", 12, "r")], "rid", _SEAMS).select("rid", "r"), "r", digits=4), "select rid, round(case when count(n_value) over w = 12 then kurtosis(n_value) over w end, 4) as r from v_events window w as (order by rid rows between 11 preceding and current row)")
over("rolling_whole_frame", "v_events", lambda df: rounded(engineer(df.select("rid", "n_value", F.length("c_type").alias("n_len")), "rolling_sum(4)", order_by="rid").select("rid", F.col("`n_rolling_sum(n_value,4)`").alias("a"), F.col("`n_rolling_sum(n_len,4)`").alias("b")), "a", digits=4), "select rid, round(case when count(n_value) over w = 4 then sum(n_value) over w end, 4) as a, (case when count(n_value) over w = 4 then sum(length(c_type)) over w end)::bigint as b from v_events window w as (order by rid rows between 3 preceding and current row)")
# expressions
_ENG = {
    "concat": ("v_part", "concat(c_brand, c_type)", "c_concat(c_brand,c_type)", "c_brand || c_type"),
    "concat3": ("v_part", "concat(c_brand, c_type, n_size)", "c_concat(c_brand,c_type,n_size)", "c_brand || c_type || n_size"),
    "mult": ("v_part", "mult(n_size, n_retail)", "n_mult(n_size,n_retail)", "round(n_size * n_retail, 4)"),
    "add": ("v_part", "add(n_size, n_retail)", "n_add(n_size,n_retail)", "round(n_size + n_retail, 4)"),
    "div": ("v_part", "div(n_retail, n_size)", "n_div(n_retail,n_size)", "round(n_retail / nullif(n_size, 0), 4)"),
    "subtract": ("v_part", "subtract(n_retail, n_size)", "n_subtract(n_retail,n_size)", "round(n_retail - n_size, 4)"),
    "avg": ("v_part", "avg(n_retail, n_size)", "n_avg(n_retail,n_size)", "round((n_retail + n_size) / 2, 4)"),
    "pow": ("v_part", "pow(n_size, 3)", "n_pow(n_size,3)", "round(pow(n_size, 3), 4)"),
    "round": ("v_part", "round(n_retail, 1)", "n_round(n_retail,1)", "round(round_even(n_retail, 1), 4)"),
    "lg": ("v_part", "lg(n_retail)", "n_lg(n_retail)", "round(ln(n_retail), 6)"),
    "safe_lg": ("v_part", "safe_lg(n_retail)", "n_safe_lg(n_retail)", "round(ln(n_retail + 1 - (select min(n_retail) from v_part)), 6)"),
    "sqrt": ("v_part", "sqrt(n_retail)", "n_sqrt(n_retail)", "round(sqrt(n_retail), 6)"),
    "nested": ("v_part", "mult(lg(mult(n_size, n_retail)), lg(pow(n_size, 3)))", "n_mult(lg(mult(n_size,n_retail)),lg(pow(n_size,3)))", "round(ln(n_size * n_retail) * ln(pow(n_size, 3)), 6)"),
}
for _k, (_v, _x, _c, _e) in _ENG.items():
    over(
        f"eng_{_k}", _v, lambda df, x=_x, c=_c, e=_e: engineer(df, x).select("rid", (F.round(F.col(f"`{c}`").cast("double"), 6 if "6)" in e else 4) if c[0] == "n" else F.col(f"`{c}`")).alias("x")),
        f"select rid, {_e} as x from {_v}",
    )
over("eng_all_pairs", "v_lineitem", lambda df: rounded(engineer(df.select("n_qty", "n_disc", "n_tax"), "mult()").agg(*[F.sum(f"`n_mult({a},{b})`").alias(f"{a}_{b}") for a, b in (("n_qty", "n_disc"), ("n_qty", "n_tax"), ("n_disc", "n_tax"))]), "n_qty_n_disc", "n_qty_n_tax", "n_disc_n_tax", digits=3), "select round(sum(n_qty * n_disc), 3) as n_qty_n_disc, round(sum(n_qty * n_tax), 3) as n_qty_n_tax, round(sum(n_disc * n_tax), 3) as n_disc_n_tax from v_lineitem")
over("eng_all_permutations", "v_part", lambda df: rounded(engineer(df.select("rid", "n_size", "n_retail"), "subtract();div()").select("rid", F.col("`n_subtract(n_size,n_retail)`").alias("a"), F.col("`n_subtract(n_retail,n_size)`").alias("b"), F.col("`n_div(n_size,n_retail)`").alias("c"), F.col("`n_div(n_retail,n_size)`").alias("d")), "a", "b", "c", "d", digits=4), "select rid, round(n_size - n_retail, 4) as a, round(n_retail - n_size, 4) as b, round(n_size / n_retail, 4) as c, round(n_retail / nullif(n_size, 0), 4) as d from v_part")
# targets and links
for _k, _e in {"log": "ln(n_total)", "arcsinh": "asinh(n_total)", "pseudoLog10": "asinh(n_total / 2) / ln(10)"}.items():
    over(f"y_{_k.lower()}", "v_orders", lambda df, k=_k: rounded(df.select("rid", scalar.YTransform(k).apply(F.col("n_total")).alias("y")), "y"), f"select rid, round({_e}, 6) as y from v_orders")
over("y_roundtrip", "v_orders", lambda df: rounded(df.select("rid", *[(lambda t: t.invert(t.apply(F.col("n_total"))))(scalar.YTransform(k)).alias(a) for k, a in (("log", "a"), ("arcsinh", "b"), ("pseudoLog10", "c"), (2.5, "d"))]), "a", "b", "c", "d", digits=3), "select rid, round(n_total, 3) as a, round(n_total, 3) as b, round(n_total, 3) as c, round(n_total, 3) as d from v_orders")
over("sigmoid", "v_orders", lambda df: rounded(df.select("rid", scalar.sigmoid(F.col("n_total") / 1000 - 200).alias("p"), scalar.bounded_sigmoid(F.col("n_total") / 1000 - 200).alias("q")), "p", "q"), "select rid, round(case when n_total / 1000 - 200 < -100 then 0.0 else 1 / (1 + exp(-(n_total / 1000 - 200))) end, 6) as p, round(1 / (1 + exp(-greatest(least(n_total / 1000 - 200, 35.0), -35.0))), 6) as q from v_orders")
over(
    "elm_activations", "v_part", lambda df: rounded(df.select("rid", *[f(F.col("n_size") / 25.0 - 1).alias(k) for k, f in scalar.ACTIVATIONS.items()], scalar.grbf(F.col("n_size") / 25.0, 2.0).alias("grbf")), *scalar.ACTIVATIONS, "grbf"),
    """select rid, round(sin(a), 6) as sine, round(tanh(a), 6) as tanh, round(least(greatest(1 - abs(a), 0.0), 1.0), 6) as tribas, round(least(greatest(abs(a), 0.0), 1.0), 6) as inv_tribas, round(1 / (1 + exp(-a)), 6) as sigmoid,
    case when a > 0 then 1.0 else 0.0 end::double as hardlim, round(least(greatest(a, 0.0), 1.0), 6) as softlim, round(exp(-a * a), 6) as gaussian, round(sqrt(1 + a * a), 6) as multiquadric, round(1 / sqrt(1 + a * a), 6) as inv_multiquadric, round(exp(exp(-pow(b, 2.0))), 6) as grbf
    from (select rid, n_size / 25.0::double - 1 as a, n_size / 25.0::double as b from v_part) t""",
)
# dates
_PARTS = "year(d)::int as c_d_order_year, month(d)::int as c_d_order_month, (isodow(d) - 1)::int as c_d_order_dayofweek, quarter(d)::int as c_d_order_quarter, (year(d) * 100 + month(d))::int as c_d_order_year_and_month, (isodow(d) - 1)::int as c_d_order_weekday, weekofyear(d)::int as c_d_order_weekofyear"
over("date_parts", "v_orders", lambda df: dates.break_down_dates(df.select("rid", "d_order")), f"select rid, {_PARTS} from (select rid, d_order as d from v_orders) t")
over("to_dates", "v_orders", lambda df: dates.to_dates(df.select("rid", F.date_format("d_order", "yyyy-MM-dd").alias("s")), "s").select("rid", F.date_format("d_s", "yyyy-MM-dd").alias("d_s")), "select rid, strftime(d_order, '%Y-%m-%d') as d_s from v_orders")
over("month_distribution", "v_orders", lambda df: dates.compare_distribution(df.where("c_status = 'F'"), df.where("c_status = 'O'"), "d_order"), "select (year(d_order) * 100 + month(d_order))::int as month, sum((c_status = 'F')::int)::bigint as n_left, sum((c_status = 'O')::int)::bigint as n_right from v_orders where c_status in ('F', 'O') group by 1")
# rows
_L = "list_value(n_size::double, n_retail, (n_size * 3)::double, n_retail / 2, nullif(n_size % 4, 0)::double)"
over(
    "row_stats", "v_part", lambda df: rounded(rows.numerical_stats(df.select("rid", "n_size", "n_retail", (F.col("n_size") * 3).alias("n_a"), (F.col("n_retail") / 2).alias("n_b"), F.when(F.col("n_size") % 4 != 0, F.col("n_size") % 4).alias("n_c"))).select("rid", "n_min", "n_max", "n_kurt", "n_mad", "n_mean", "n_median", "n_sem", "n_std", "n_sum"), "n_min", "n_max", "n_kurt", "n_mad", "n_mean", "n_median", "n_sem", "n_std", "n_sum", digits=4),
    f"""select rid, round(list_min(v), 4) as n_min, round(list_max(v), 4) as n_max, round(list_kurtosis(v), 4) as n_kurt, round(list_avg(list_transform(v, lambda x: abs(x - list_avg(v)))), 4) as n_mad, round(list_avg(v), 4) as n_mean, round(list_median(v), 4) as n_median,
    round(list_stddev_samp(v) / sqrt(len(v)), 4) as n_sem, round(list_stddev_samp(v), 4) as n_std, round(list_sum(v), 4) as n_sum from (select rid, list_filter({_L}, lambda x: x is not null) as v from v_part) t""",
)
for _k, _e in {"maximum": "greatest({})", "minimum": "least({})", "uniform": "({}) / 3"}.items():
    _p = ["n_size, n_size, n_retail", "n_size, n_retail, n_a", "n_retail, n_a, n_a"]
    over(
        f"row_filter_{_k}", "v_part", lambda df, k=_k: rounded(rows.noise_filter(df.select("rid", "n_size", "n_retail", (F.col("n_size") * 30).alias("n_a")), k, 3), "n_size", "n_retail", "n_a", digits=4),
        "select rid, " + ", ".join(f"round(({_e.format(x if _k != 'uniform' else x.replace(',', ' +'))})::double, 4) as {c}" for x, c in zip(_p, ("n_size", "n_retail", "n_a"))) + " from (select rid, n_size::double as n_size, n_retail, n_size * 30.0::double as n_a from v_part) t",
    )
_GAUSS = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
_SEEN = [["n_size" if (i + k) % 4 in (0, 3) else "n_retail" for k in range(-4, 5)] for i in (0, 1)]  # mirrored at both edges: a a b b a a b b
over(
    "row_filter_gaussian", "v_part", lambda df: rounded(rows.noise_filter(df.select("rid", "n_size", "n_retail"), "gaussian", 1.0), "n_size", "n_retail", digits=4),
    "select rid, " + ", ".join(f"round({' + '.join(f'{c} * {w / sum(_GAUSS)!r}::double' for c, w in zip(cells, _GAUSS))}, 4) as {name}" for name, cells in zip(("n_size", "n_retail"), _SEEN)) + " from v_part",
)


# sets
@query("append_bottom", "select c_nationkey as i_nation, c_acctbal as n_bal, c_mktsegment as c_seg from customer union all select s_nationkey, s_acctbal, null from supplier")
def _append_bottom(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("i_nation"), F.col("c_acctbal").alias("n_bal"), F.col("c_mktsegment").alias("c_seg"))
    return sets.append_bottom(a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("i_nation"), F.col("s_acctbal").alias("n_bal")))


@query("append_right", "select p_partkey, p_brand, s_suppkey, s_name from (select *, row_number() over (order by p_partkey) as k from part) a join (select *, row_number() over (order by s_suppkey) as k from supplier) b using (k)")
def _append_right(spark, sf):
    return order.append_right(table(spark, sf, "part").select("p_partkey", "p_brand"), table(spark, sf, "supplier").select("s_suppkey", "s_name"), "p_partkey", "s_suppkey")


@query("difference_with", "(select doc_id as value, 'left' as side from documents except select doc_id, 'left' from labels) union all (select doc_id, 'right' from labels except select doc_id, 'right' from documents)")
def _difference(spark, sf):
    return sets.difference_with(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("similarity", """with a as (select distinct c_brand as v from (select p_brand as c_brand from part where p_size <= 3) x), b as (select distinct p_brand as v from part where p_size > 48)
    select 'c_brand' as "column", count(b.v) as shared, count(*) - count(b.v) as only_left, round((count(*) - count(b.v)) * 100.0 / count(*), 4) as pct_different, count(*) = 1 as single_valued from a left join b on a.v = b.v""")
def _similarity(spark, sf):
    p = view(spark, sf, "v_part")
    return rounded(sets.describe_similarity(p.where("n_size <= 3"), p.where("n_size > 48"), ["c_brand"]), "pct_different", digits=4)


@query("is_equal", "select true as same, false as changed, true as close")
def _is_equal(spark, sf):
    p = view(spark, sf, "v_part").select("rid", "n_retail")
    more = p.withColumn("n_retail", F.col("n_retail") + F.when(F.col("rid") == 1, 1.0).otherwise(0.0))
    near = p.withColumn("n_retail", F.col("n_retail") * (1 + 1e-7))
    return spark.createDataFrame([(sets.is_equal(p, p, "rid"), sets.is_equal(p, more, "rid"), sets.all_close(p, near, "rid"))], "same boolean, changed boolean, close boolean")


# evaluation
over("value_counts", _NULLS, lambda df: evaluate.value_counts(df, "c_priority"), "select c_priority as value, count(*) as n from v_orders_null group by 1")
over("percentage_positive", "v_docs", lambda df: rounded(evaluate.percentage_positive(df, "b_quality", 1), "share"), "select round(avg((b_quality = 1)::int), 6) as share from v_docs")
over(
    "column_profile", _NULLS, lambda df: rounded(profile.column_profile(df, ["c_status", "c_priority", "n_total"]).select("column", "role", "n", "n_null", "n_distinct", "mean", "variance"), "mean", "variance", digits=3),
    """select 'c_status' as "column", 'categorical' as role, count(*) as n, count(*) - count(c_status) as n_null, count(distinct c_status) as n_distinct, null::double as mean, null::double as variance from v_orders_null
    union all select 'c_priority', 'categorical', count(*), count(*) - count(c_priority), count(distinct c_priority), null, null from v_orders_null
    union all select 'n_total', 'numerical', count(*), count(*) - count(n_total), count(distinct n_total), round(avg(n_total), 3), round(var_samp(n_total), 3) from v_orders_null""",
)
over("f_regression", "v_lineitem", lambda df: rounded(evaluate.f_regression(df, ["n_qty", "n_disc"], "n_price"), "f_score", digits=3), """select 'n_qty' as "column", round(r * r / (1 - r * r) * (n - 2), 3) as f_score from (select corr(n_qty, n_price) r, count(*) n from v_lineitem) t union all select 'n_disc', round(r * r / (1 - r * r) * (n - 2), 3) from (select corr(n_disc, n_price) r, count(*) n from v_lineitem) t""")
_SUMS = "(select b_quality, count(n_chars)::double n, sum(n_chars)::double s, sum(n_chars::double * n_chars) q from v_docs group by 1) t"
over("f_classif", "v_docs", lambda df: rounded(evaluate.f_classification(df, ["n_chars"], "b_quality"), "f_score", digits=4), f"""select 'n_chars' as "column", round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 4) as f_score from {_SUMS}""")
over("chi2_score", "v_docs", lambda df: rounded(evaluate.chi2(df, ["n_chars"], "b_quality"), "chi2", digits=3), f"""select 'n_chars' as "column", round(sum((s - e) * (s - e) / e), 3) as chi2 from (select s, (sum(s) over ()) * n / (sum(n) over ()) as e from {_SUMS}) u""")
over("covariance", "v_lineitem", lambda df: rounded(evaluate.covariance(df, "n_qty", "n_price"), "covariance", "pearson", digits=4), "select round(covar_samp(n_qty, n_price), 4) as covariance, round(corr(n_qty, n_price), 4) as pearson from v_lineitem")
over("spearman", "v_part", lambda df: rounded(evaluate.spearman(df, "n_size", "n_retail"), "spearman"), "select round(corr(a, b), 6) as spearman from (select rank() over (order by n_size) + (count(*) over (partition by n_size) - 1) / 2.0 as a, rank() over (order by n_retail) + (count(*) over (partition by n_retail) - 1) / 2.0 as b from v_part) t")
over("confusion", "v_preds", lambda df: evaluate.confusion(df.withColumn("p", (F.col("p1") > 0.5).cast("int")), "y", "p"), "select y, (p1 > 0.5)::int as p, count(*) as n from v_preds group by 1, 2")
_BINS = "select b::int as bin, mean_score, mean_truth, coalesce(n, 0) as n from range(1, {k} + 1) r(b) left join (select ceil(p * {k}) as bin, round(avg(p), 6) as mean_score, round(avg(y), 6) as mean_truth, count(*) as n from ({p}) t where p > 0 group by 1) u on bin = b"
over("reliability", "v_preds", lambda df: rounded(evaluate.reliability_curve(df, "y", "p1"), "mean_score", "mean_truth"), _BINS.format(k=10, p="select y, p1 as p from v_preds"))
over("reliability_empty_bins", "v_preds", lambda df: rounded(evaluate.reliability_curve(df.where("p1 < 0.3 or p1 > 0.8"), "y", "p1", 20), "mean_score", "mean_truth"), _BINS.format(k=20, p="select y, p1 as p from v_preds where p1 < 0.3 or p1 > 0.8"))
over("reliability_normalised", "v_preds", lambda df: rounded(evaluate.reliability_curve(df.where("p1 > 0.2"), "y", "p1", 7, True), "mean_score", "mean_truth"), _BINS.format(k=7, p="select y, (p1 - min(p1) over ()) / (max(p1) over () - min(p1) over ()) as p from v_preds where p1 > 0.2"))
over("bland_altman", "v_preds", lambda df: rounded(evaluate.bland_altman(df, "p1", "p2"), "md", "sd", "lower", "upper"), "select round(md, 6) as md, round(sd, 6) as sd, round(md - 2 * sd, 6) as lower, round(md + 2 * sd, 6) as upper from (select avg(p1 - p2) md, stddev_pop(p1 - p2) sd from v_preds) t")
over("logloss", "v_preds", lambda df: rounded(evaluate.mean_log_loss(df, "p1", "y"), "log_loss"), "select round(avg(-ln(case when y = 1 then p else 1 - p end)), 6) as log_loss from (select y, greatest(least(p1, 1 - 1e-14), 1e-14) as p from v_preds) t")
over("cv_summary", "v_preds", lambda df: rounded(evaluate.mean_and_error(df, "p1"), "mean", "sem"), "select round(avg(p1), 6) as mean, round(stddev_samp(p1) / sqrt(count(p1)), 6) as sem from v_preds")
_VOTES = {"mean": "(p1 + p2 + p3) / 3", "median": "list_median(list_value(p1, p2, p3))", "max": "greatest(p1, p2, p3)", "min": "least(p1, p2, p3)"}
for _k, _e in _VOTES.items():
    over(f"vote_{_k}", "v_preds", lambda df, k=_k: rounded(df.select("rid", evaluate.vote(["p1", "p2", "p3"], k).alias("vote")), "vote"), f"select rid, round({_e}, 6) as vote from v_preds")
over("vote_weighted", "v_preds", lambda df: rounded(df.select("rid", evaluate.vote(["p1", "p2", "p3"], "mean", [1, 2, 3]).alias("vote")), "vote"), "select rid, round((p1 + 2 * p2 + 3 * p3) / 6, 6) as vote from v_preds")
over("vote_majority", "v_preds", lambda df: df.select("rid", *[F.floor(F.col(p) * 4).cast("int").alias(n) for p, n in (("p1", "a"), ("p2", "b"), ("p3", "c"))]).select("rid", evaluate.vote(["a", "b", "c"]).alias("vote")), "select rid, case when a = b or a = c then a when b = c then b else least(a, b, c) end as vote from (select rid, floor(p1 * 4)::int a, floor(p2 * 4)::int b, floor(p3 * 4)::int c from v_preds) t")
over("histogram", "v_part", lambda df: profile.histogram(df, "n_retail", 12), "select least(floor((n_retail - lo) * 12 / (hi - lo)), 11)::int as bin, count(*) as n from v_part, (select min(n_retail) lo, max(n_retail) hi from v_part) s group by 1")
over("relation_box", "v_orders", lambda df: rounded(profile.relation(df, "n_total", "c_status"), "min", "q1", "median", "q3", "max", digits=4), "select c_status, round(min(n_total), 4) as min, round(quantile_cont(n_total, 0.25), 4) as q1, round(median(n_total), 4) as median, round(quantile_cont(n_total, 0.75), 4) as q3, round(max(n_total), 4) as max, count(n_total) as n from v_orders group by 1")


over("relation_grid", "v_part", lambda df: profile.relation(df, "n_size", "n_retail", 8), """select least(floor((n_size - a) * 8 / (b - a)), 7)::int as n_size, least(floor((n_retail - c) * 8 / (d - c)), 7)::int as n_retail, count(*) as n
    from v_part, (select min(n_size)::double a, max(n_size)::double b, min(n_retail)::double c, max(n_retail)::double d from v_part) s group by 1, 2""")
over("relation_classes", "v_orders", lambda df: profile.relation(df, "c_status", "c_priority"), "select c_status, c_priority, count(*) as n from v_orders group by 1, 2")
over("compare_predictions", "v_preds", lambda df: rounded(profile.compare_predictions(df, "p1", "p2"), "covariance", "pearson", "md", "sd", "lower", "upper"), "select round(covar_samp(p1, p2), 6) as covariance, round(corr(p1, p2), 6) as pearson, round(avg(p1 - p2), 6) as md, round(stddev_pop(p1 - p2), 6) as sd, round(avg(p1 - p2) - 2 * stddev_pop(p1 - p2), 6) as lower, round(avg(p1 - p2) + 2 * stddev_pop(p1 - p2), 6) as upper from v_preds")
over("compare_predictions_classes", "v_preds", lambda df: profile.compare_predictions(df.withColumn("p", (F.col("p1") > 0.5).cast("int")), "y", "p"), "select y, (p1 > 0.5)::int as p, count(*) as n from v_preds group by 1, 2")
over("feature_scores", "v_docs", lambda df: rounded(profile.feature_scores(df.withColumn("y", F.col("b_quality")), "y", ["n_chars"]).select("column", "f_regression", "f_classification", "chi2", "variance"), "f_regression", "f_classification", "chi2", "variance", digits=3), f"""select 'n_chars' as "column", (select round(r * r / (1 - r * r) * (n - 2), 3) from (select corr(n_chars, b_quality) r, count(*) n from v_docs) a) as f_regression,
    (select round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 3) from {_SUMS}) as f_classification,
    (select round(sum((s - e) * (s - e) / e), 3) from (select s, (sum(s) over ()) * n / (sum(n) over ()) as e from {_SUMS}) u) as chi2, (select round(var_samp(n_chars), 3) from v_docs) as variance""")


@query("infer_roles", """select * from (values ('o_orderkey', 'index'), ('o_custkey', 'index'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numerical'), ('o_orderdate', 'date'), ('o_orderpriority', 'categorical'), ('two', 'binary'), ('c_own', 'categorical')) t("column", role)""")
def _infer(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", (F.col("o_orderkey") % 2).alias("two"), F.lit(1).alias("c_own"))
    return spark.createDataFrame(list(roles.infer_roles(df).items()), "column string, role string")


@query("annotated_roles", "select o_orderkey, avg((o_totalprice - m) / s) as n from orders, (select avg(o_totalprice) m, stddev_samp(o_totalprice) s from orders) t group by 1 having false")
def _annotated(spark, sf):
    """Roles that the data give are chosen by operators too: every categorical is imputed, so no row is left over."""
    df = roles.annotate(table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice"))
    filled = clean.missing(df, "mode", "mean")
    return filled.where("o_orderstatus is null").select("o_orderkey", F.col("o_totalprice").alias("n"))


# folds and order
@query("label_folds", "select rid, i_nation, fold from (select rid, i_nation from v_orders_seg) o join (select i_nation, (case when r < m * (s + 1) then r // (s + 1) else m + (r - m * (s + 1)) // greatest(s, 1) end)::int as fold from (select i_nation, row_number() over (order by f) - 1 as r, count(*) over () // 4 as s, count(*) over () % 4 as m from (select i_nation, min(rid) as f from v_orders_seg group by 1) a) b) c using (i_nation)", "v_orders_seg")
def _label_folds(spark, sf):
    return sample.label_folds(view(spark, sf, "v_orders_seg").select("rid", "i_nation"), "i_nation", "rid", 4)


over("restore_order", "v_events", lambda df: folds.restore_order(df.select("rid", "c_type"), "rid"), "select rid, c_type from v_events order by rid")


# serialisers
def _part(spark, sf):
    return view(spark, sf, "v_part").select("rid", "n_size", F.round("n_retail", 2).alias("n_retail"), "c_type", (F.col("rid") % 2).alias("y"))


_P = "with p as (select p_partkey as rid, p_size::double as n_size, round(p_retailprice, 2) as n_retail, p_type as c_type, p_partkey % 2 as y from part), "
_P_CELLS = _P + """cells as (select rid, 0 as pos, 'n' as kind, 'n_size' as feature, n_size as v from p where n_size <> 0 union all select rid, 1, 'n', 'n_retail', n_retail from p where n_retail <> 0 union all select rid, 2, 'c', 'c_type_' || c_type, 1.0 from p),
  ids as (select feature, row_number() over (order by f, fp) - 1 as id from (select feature, min(rid) as f, arg_min(pos, rid) as fp from cells group by 1) t),
  tok as (select rid, pos, kind, id, case when v = floor(v) then cast(cast(v as bigint) as varchar) else rtrim(printf('%.10f', v), '0') end as value from cells join ids using (feature)) """
query("to_vw", _P_CELLS + """select rid, (case when y = 0 then '-1.0' else '1.0' end) || ' |n ' || string_agg(case when kind = 'n' then id || ':' || value end, ' ' order by pos) || ' |c ' || string_agg(case when kind = 'c' then id::varchar end, ' ' order by pos) as line from tok join (select rid, y from p) q using (rid) group by rid, y""")(lambda spark, sf: serialize.to_vw(_part(spark, sf), "rid", "y"))
query("to_svmlight", _P_CELLS + """select rid, (case when y = 0 then '-1.0' else '1.0' end) || ' ' || string_agg((id + 1) || ':' || value, ' ' order by id) as line from tok join (select rid, y from p) q using (rid) group by rid, y""")(lambda spark, sf: serialize.to_svmlight(_part(spark, sf), "rid", "y"))
query("to_libfm", _P_CELLS + """select rid, (case when y = 0 then '0.0' else '1.0' end) || ' ' || string_agg(id || ':' || value, ' ' order by pos) as line from tok join (select rid, y from p) q using (rid) group by rid, y""")(lambda spark, sf: serialize.to_libfm(_part(spark, sf), "rid", "y"))
query("to_libffm", _P + """t as (select rid, y, n_size::bigint as a, case when n_retail = floor(n_retail) then cast(cast(n_retail as bigint) as varchar) else rtrim(printf('%.10f', n_retail), '0') end as b from p) select rid, y || ' 0:0:' || a || ' 1:0:' || b as line from t""")(lambda spark, sf: serialize.to_libffm(_part(spark, sf).drop("c_type"), "rid", "y"))


query("to_vw_weighted", _P + """cells as (select rid, 1 as pos, 'n' as kind, 'n_retail' as feature, n_retail as v from p where n_retail <> 0 union all select rid, 2, 'c', 'c_type_' || c_type, 1.0 from p),
  ids as (select feature, row_number() over (order by f, fp) - 1 as id from (select feature, min(rid) as f, arg_min(pos, rid) as fp from cells group by 1) t),
  tok as (select rid, kind, id, case when v = floor(v) then cast(cast(v as bigint) as varchar) else rtrim(printf('%.10f', v), '0') end as value from cells join ids using (feature)),
  own as (select rid, y, n_size::bigint as w, row_number() over (order by rid) - 1 as tag from p)
  select rid, (case when y = 0 then '-1.0' else '1.0' end) || (case when w <> 1 then ' ' || w else '' end) || chr(32) || chr(39) || tag || ' |n ' || string_agg(case when kind = 'n' then id || ':' || value end, ' ') || ' |c ' || string_agg(case when kind = 'c' then id::varchar end, ' ') as line from tok join own using (rid) group by rid, y, w, tag""")(
    lambda spark, sf: serialize.to_vw(_part(spark, sf), "rid", "y", "n_size")
)


# samples, models: checked by properties in the tests, and by what SQL can say of them
over("subsample_size", "v_orders", lambda df: sample.subsample(df.select("rid", "n_total"), 0.1, "rid", 3).agg(F.count("*").alias("n"), F.count_distinct("rid").alias("n_distinct")), "select floor(count(*) * 0.1::double)::bigint as n, floor(count(*) * 0.1::double)::bigint as n_distinct from v_orders")
over("shuffle_rows", "v_orders", lambda df: sample.shuffle(df.select("rid", "n_total"), "rid", 3).select("rid", F.round("n_total", 2).alias("n_total")), "select rid, round(n_total, 2) as n_total from v_orders")
over(
    "split_sizes", "v_docs", lambda df: (lambda p: p[0].groupBy("b_quality").agg(F.count("*").alias("train")).join(p[1].groupBy("b_quality").agg(F.count("*").alias("test")), "b_quality"))(sample.split(df, "rid", 0.7, 1, "b_quality")),
    "select b_quality, floor(count(*) * 0.7::double)::bigint as train, floor(count(*) * (1 - 0.7::double))::bigint as test from v_docs group by 1",
)
over(
    "stratified_folds", "v_docs", lambda df: sample.with_folds(df, 4, "rid", 2, stratify="b_quality").groupBy("b_quality", "fold").agg(F.count("*").alias("n")),
    "select b_quality, f::int as fold, (n // 4 + (f < n % 4)::int)::bigint as n from (select b_quality, count(*) as n from v_docs group by 1) t, range(4) r(f)",
)
over("shuffle", "v_orders", lambda df: sample.shuffle(df.select("rid", "n_total"), "rid", 3))
over("subsample", "v_orders", lambda df: sample.subsample(df.select("rid", "n_total"), 0.1, "rid", 3))
over("split_stratified", "v_docs", lambda df: sample.split(df, "rid", 0.7, 1, "b_quality")[0])
over("add_noise", "v_part", lambda df: clean.add_noise(df.select("rid", "n_retail"), level=0.2, seed=1))
over("boxcox", "v_part", lambda df: scalar.boxcox_columns(df.select("rid", "n_retail"), ["n_retail"]))
over("boxcox_given", "v_part", lambda df: rounded(df.select("rid", scalar.box_cox(F.col("n_retail"), 0.5).alias("a"), scalar.box_cox(F.col("n_retail"), 0.0).alias("b")), "a", "b"), "select rid, round((sqrt(n_retail) - 1) / 0.5, 6) as a, round(ln(n_retail), 6) as b from v_part")


def _docs(spark, sf):
    return view(spark, sf, "v_docs").withColumns({"n_len": F.log1p("n_chars"), "y": F.col("b_quality").cast("double")}).select("rid", "n_len", "n_chars", "y", "c_lang")


@query("oof_predict")
def _oof(spark, sf):
    from pyspark.ml.classification import LogisticRegression

    ready = folds.assemble(_docs(spark, sf), ["n_len"])
    return folds.self_predict_proba(ready, LogisticRegression(labelCol="y", maxIter=20), "rid", 3).select("rid", "y", "prediction", F.col("proba")[1].alias("proba"))


@query("kmeans")
def _kmeans(spark, sf):
    return features.kmeans(_docs(spark, sf), 4, ["n_len", "n_chars"]).select("rid", "i_cluster")


@query("pca")
def _pca(spark, sf):
    return features.pca(view(spark, sf, "v_lineitem").select("n_qty", "n_price", "n_disc", "n_tax"), 2).select("n_pca_0", "n_pca_1")


@query("calibrate")
def _calibrate(spark, sf):
    return ensemble.calibrate(view(spark, sf, "v_preds"), "y", "p1").select("rid", "p1", "calibrated")


@query("greedy_two", """, l as (select rid, y, m, p from v_preds unpivot (p for m in (p1, p2, p3))), a as (select m, -avg((y - p) * (y - p)) as s from l group by 1), f as (select m, s from a order by s desc, m desc limit 1),
    b as (select l.m, -avg((l.y - (l.p + k.p) / 2) * (l.y - (l.p + k.p) / 2)) as s from l join l k on l.rid = k.rid and k.m = (select m from f) where l.m <> (select m from f) group by 1)
    select 0 as step, m as model, round(s, 6) as score from f union all (select 1, m, round(s, 6) from b order by s desc, m desc limit 1)""", "v_preds")
def _greedy_two(spark, sf):
    picks = ensemble.greedy_ensemble(view(spark, sf, "v_preds"), "y", ["p1", "p2", "p3"], epochs=2)
    return rounded(spark.createDataFrame([(i, c, float(s)) for i, (c, s) in enumerate(picks)], "step int, model string, score double"), "score")


@query("greedy_ensemble")
def _greedy(spark, sf):
    picks = ensemble.greedy_ensemble(view(spark, sf, "v_preds"), "y", ["p1", "p2", "p3"], epochs=5, max_replacements=1)
    return spark.createDataFrame([(i, c, float(s)) for i, (c, s) in enumerate(picks)], "step int, model string, score double")


@query("optimise_two", "select round(w, 3) as p1, round(1 - w, 3) as p2 from (select greatest(least(sum((p1 - p2) * (y - p2)) / sum((p1 - p2) * (p1 - p2)), 1.0), 0.0) as w from v_preds) t", "v_preds")
def _optimise_two(spark, sf):
    found = ensemble.optimise_weights(view(spark, sf, "v_preds"), "y", ["p1", "p2"], rounds=5_000)
    return rounded(spark.createDataFrame([(found["p1"], found["p2"])], "p1 double, p2 double"), "p1", "p2", digits=3)


@query("optimise_weights")
def _optimise(spark, sf):
    found = ensemble.optimise_weights(view(spark, sf, "v_preds"), "y", ["p1", "p2", "p3"])
    return spark.createDataFrame(list(found.items()), "model string, weight double")


@query("smote")
def _smote(spark, sf):
    return features.smote(_docs(spark, sf), "y", 0.0, "rid", ["n_len", "n_chars"], 200, 3)


@query("elm")
def _elm(spark, sf):
    part = view(spark, sf, "v_part")
    return features.ELM(features.RandomLayer(units=8, seed=1)).fit(clean.scale(part, ["n_size"]), ["n_size"], "n_retail").transform(clean.scale(part, ["n_size"])).select("rid", "prediction")


@query("ftrl")
def _ftrl(spark, sf):
    from tessera.streaming import ftrl

    docs = _docs(spark, sf)
    model = ftrl.fit(docs, ["c_lang"], "y", ftrl.FTRL(bits=12))
    return ftrl.predict(docs, ["c_lang"], model).select("rid", "prediction")


@query("factorisation_machine")
def _fm(spark, sf):
    docs = _docs(spark, sf)
    return learners.factorisation_machine(["c_lang", "n_len"], "y", passes=10, bits=8).fit(docs).transform(docs).select("rid", "prediction")


def flagship(spark, sf_dir: str) -> DataFrame:
    """Clean, scale, decompose dates and encode a category by its target."""
    df = clean.missing(view(spark, sf_dir, "v_orders_seg"), "mode", "mean")
    df = encode.cats_to_stat(dates.break_down_dates(df), "n_total", "mean", columns=["c_segment"])
    return rounded(clean.normalise(df, ["n_total"]), "n_total", "n_c_segment_mean", digits=4)


query("flagship", f"""select rid, c_status, c_priority, i_nation, round((n_total - lo) / (hi - lo), 4) as n_total, {_PARTS}, round(s, 4) as n_c_segment_mean
    from (select *, d_order as d from v_orders_seg) o join (select c_segment, avg(n_total) as s from v_orders_seg group by 1) t using (c_segment), (select min(n_total) lo, max(n_total) hi from v_orders_seg) m""", "v_orders_seg")(flagship)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
