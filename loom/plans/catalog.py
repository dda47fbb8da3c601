"""Registered driver queries and their DuckDB oracle SQL.

Each query reads the given tables (whole tables, no row caps) and returns a
DataFrame; the oracle SQL computes the same result independently.  Derived
inputs (injected NULLs, rule-based predictions, learnable targets) are the same
SQL expressions in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import convert as CV
from ..operators import encode as EN
from ..operators import evaluate as EV
from ..operators import explore as EX
from ..operators import models as MO
from ..operators import profile as P
from ..operators import sampling as SA
from ..operators import scale as SC
from ..functions.quantile import kth_smallest, quantiles
from ..sources.readers import load
from . import recipes as RC
from ..workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.readers import normalise_missing
    return normalise_missing(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Derived inputs ------------------------------------------------------------------------
EVENTS_NA_SQL = """SELECT event_id, user_id,
   CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
   CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type FROM events"""


def events_na(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id",
                    F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
                    F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"))


def _summary_sql(tbl: str, nums: list[str], cats: list[str], digits: int = 6, src: str | None = None) -> str:
    parts = []
    src = src or tbl
    for c in nums:
        parts.append(f"""SELECT '{c}' AS "column", 'Numerical' AS class, count_if({c} IS NULL)::BIGINT AS missing,
  round(min({c})::DOUBLE, {digits}) AS min, round(median({c})::DOUBLE, {digits}) AS median,
  round(max({c})::DOUBLE, {digits}) AS max, round(avg({c})::DOUBLE, {digits}) AS mean,
  round(stddev_samp({c}), {digits}) AS sd, round(var_samp({c}), {digits}) AS variance,
  NULL::BIGINT AS unique_values FROM {src}""")
    for c in cats:
        parts.append(f"""SELECT '{c}', 'Categorical', count_if({c} IS NULL)::BIGINT, NULL::DOUBLE, NULL::DOUBLE,
  NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
  (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT FROM {src}""")
    return "\nUNION ALL\n".join(parts)


# P4 summary ----------------------------------------------------------------------------
_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_CAT = ["l_returnflag", "l_linestatus", "l_shipdate"]


@register("summary_lineitem", _summary_sql("lineitem", _LI_NUM, _LI_CAT))
def q_summary_lineitem(spark, sf_dir):
    return P.summary(table(spark, sf_dir, "lineitem"), digits=6)


@register("summary_events_na", "WITH events_na AS (" + EVENTS_NA_SQL + ")\n"
          + _summary_sql("events_na", ["event_id", "user_id", "value"], ["event_type"]))
def q_summary_events_na(spark, sf_dir):
    return P.summary(events_na(spark, sf_dir), digits=6)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation rounding of every double column (summation order differs between engines)."""
    from pyspark.sql import types as T
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _ws_events_na(spark, sf_dir):
    return Workspace.from_df(events_na(spark, sf_dir), key="event_id")


WITH_EVENTS_NA = "WITH events_na AS (" + EVENTS_NA_SQL + ")\n"


# S2 load ------------------------------------------------------------------------------
@register("load_parquet", "SELECT count(*) AS n FROM lineitem")
def q_load_parquet(spark, sf_dir):
    return load(spark, f"{sf_dir}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"))


@register("load_ranges_lineitem", """
SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice >= 5000 AND NOT isnan(l_extendedprice) AND l_partkey <= 1000000
GROUP BY l_returnflag""")
def q_load_ranges(spark, sf_dir):
    kept = load(spark, f"{sf_dir}/lineitem.parquet", ranges={
        "l_quantity": (10, 20), "l_extendedprice": (5000, None), "l_partkey": (None, 1_000_000)})
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


# S6 browse ----------------------------------------------------------------------------
@register("browse_customer", """
SELECT * FROM customer
WHERE lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) LIKE '%build%'
ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10""")
def q_browse_customer(spark, sf_dir):
    return P.browse(table(spark, sf_dir, "customer"), search="build", order_by="c_acctbal", descending=True,
                    page=2, page_size=10, key="c_custkey")


@register("browse_deep_orders", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 990""")
def q_browse_deep(spark, sf_dir):
    """The way of pages beyond BROADCAST_ROWS rows, taken here from 500 rows on."""
    return P.browse(table(spark, sf_dir, "orders"), order_by="o_totalprice", descending=True, page=100, page_size=10,
                    key="o_orderkey", direct_rows=500)


# P1 file details ----------------------------------------------------------------------
@register("file_details_orders", """
SELECT 'orders' AS file_name, 'parquet' AS file_format, count(*) AS n_rows,
       6::BIGINT AS n_columns, 2::BIGINT AS n_categorical, 4::BIGINT AS n_numerical FROM orders""")
def q_file_details_orders(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    return P.file_details(load(spark, path), path)


# P3 qualitative -----------------------------------------------------------------------
def _qual_sql(tbl, nums, others, strings):
    parts = []
    for c in nums + others + strings:
        n = f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT"
        q = f"{n} <= 10" if c in nums else ("true" if c in strings else "false")
        parts.append(f"""SELECT '{c}' AS "column", {n} AS n_distinct, {q} AS qualitative FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


@register("qualitative_lineitem", _qual_sql("lineitem", _LI_NUM, ["l_shipdate"], ["l_returnflag", "l_linestatus"]))
def q_qualitative_lineitem(spark, sf_dir):
    return P.qualitative(table(spark, sf_dir, "lineitem"))


# P5 missing percent -------------------------------------------------------------------
@register("qualitative_flags_lineitem", "SELECT \"column\", qualitative FROM ("
          + _qual_sql("lineitem", _LI_NUM, ["l_shipdate"], ["l_returnflag", "l_linestatus"]) + ")")
def q_qualitative_flags_lineitem(spark, sf_dir):
    return P.qualitative_flags(table(spark, sf_dir, "lineitem").select(*_LI_NUM, *_LI_CAT))


@register("missing_percent_value", WITH_EVENTS_NA + """
SELECT round(100.0 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 2)::DOUBLE AS missing_percent FROM events_na""")
def q_missing_percent_value(spark, sf_dir):
    return P.missing_percent(events_na(spark, sf_dir), "value")


# P6 describe --------------------------------------------------------------------------
@register("describe_value", WITH_EVENTS_NA + """
SELECT round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median,
       round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max,
       count_if(value IS NULL)::BIGINT AS na_count, round(stddev_samp(value), 6) AS sd FROM events_na""")
def q_describe_value(spark, sf_dir):
    return P.describe_one(events_na(spark, sf_dir), "value", digits=6)


# P7 target summary --------------------------------------------------------------------
@register("target_summary_totalprice", """
WITH s AS (SELECT avg(o_totalprice) a, median(o_totalprice) m, min(o_totalprice) lo, max(o_totalprice) hi,
                  var_samp(o_totalprice) v, stddev_samp(o_totalprice) sd, count(o_totalprice) n FROM orders)
SELECT 'Mean' AS metric, round(a, 2) AS value FROM s UNION ALL SELECT 'Median', round(m, 2) FROM s
UNION ALL SELECT 'Min', round(lo, 2) FROM s UNION ALL SELECT 'Max', round(hi, 2) FROM s
UNION ALL SELECT 'Range', round(hi - lo, 2) FROM s UNION ALL SELECT 'Variance', round(v, 2) FROM s
UNION ALL SELECT 'SD', round(sd, 2) FROM s UNION ALL SELECT 'N', n::DOUBLE FROM s""")
def q_target_summary_totalprice(spark, sf_dir):
    return P.target_summary(table(spark, sf_dir, "orders"), "o_totalprice", digits=2)


# P8 target distribution ---------------------------------------------------------------
@register("target_dist_segment", """
SELECT c_mktsegment AS level, count(*) AS count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def q_target_dist_segment(spark, sf_dir):
    return P.target_distribution(table(spark, sf_dir, "customer"), "c_mktsegment")


# P9 audit -----------------------------------------------------------------------------
@register("audit_events_na", WITH_EVENTS_NA + """
SELECT true AS has_categorical, false AS one_hot_applied,
       coalesce(bool_or(user_id IS NULL OR value IS NULL OR event_type IS NULL), false) AS has_missing FROM events_na""")
def q_audit_events_na(spark, sf_dir):
    return P.audit(_ws_events_na(spark, sf_dir))


# C1-C3 --------------------------------------------------------------------------------
@register("drop_features_part", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def q_drop_features_part(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "part"), key="p_partkey")
    return CV.drop_features(ws, ["p_name", "p_type"]).working()


@register("num_to_cat_size", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def q_num_to_cat_size(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "part").select("p_partkey", "p_size"), key="p_partkey")
    return CV.num_to_cat(ws, ["p_size"]).working()


@register("cat_to_num_brand", """
SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, 'Brand#', '') AS DOUBLE) AS p_brand FROM part""")
def q_cat_to_num_brand(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").alias("p_brand"))
    ws, _converted, _failed = CV.cat_to_num(Workspace.from_df(part, key="p_partkey"), ["p_brand"])
    return ws.working()


# M1-M5 --------------------------------------------------------------------------------
@register("impute_drop", WITH_EVENTS_NA + "SELECT * FROM events_na WHERE value IS NOT NULL")
def q_impute_drop(spark, sf_dir):
    return CL.impute(_ws_events_na(spark, sf_dir), "value", "drop").working()


@register("impute_mode_num", WITH_EVENTS_NA + """,
m AS (SELECT value AS v FROM events_na WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)
SELECT event_id, user_id, coalesce(value, (SELECT v FROM m)) AS value, event_type FROM events_na""")
def q_impute_mode_num(spark, sf_dir):
    return CL.impute(_ws_events_na(spark, sf_dir), "value", "mode").working()


@register("impute_mode_str", WITH_EVENTS_NA + """,
m AS (SELECT event_type AS v FROM events_na WHERE event_type IS NOT NULL GROUP BY event_type
      ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, user_id, value, coalesce(event_type, (SELECT v FROM m)) AS event_type FROM events_na""")
def q_impute_mode_str(spark, sf_dir):
    return CL.impute(_ws_events_na(spark, sf_dir), "event_type", "mode").working()


@register("impute_median", WITH_EVENTS_NA + """
SELECT event_id, user_id, round(coalesce(value, (SELECT median(value) FROM events_na)), 6) AS value, event_type
FROM events_na""")
def q_impute_median(spark, sf_dir):
    return round_doubles(CL.impute(_ws_events_na(spark, sf_dir), "value", "median").working())


@register("impute_mean", WITH_EVENTS_NA + """
SELECT event_id, user_id, round(coalesce(value, (SELECT avg(value) FROM events_na)), 6) AS value, event_type
FROM events_na""")
def q_impute_mean(spark, sf_dir):
    return round_doubles(CL.impute(_ws_events_na(spark, sf_dir), "value", "mean").working())


@register("na_omit_events", WITH_EVENTS_NA + """
SELECT * FROM events_na WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL
  AND event_type IS NOT NULL""")
def q_na_omit_events(spark, sf_dir):
    return CL.na_omit(events_na(spark, sf_dir))


# O1-O4 --------------------------------------------------------------------------------
_FENCES = """, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_na),
f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


@register("iqr_bounds_value", WITH_EVENTS_NA + _FENCES + """
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower, round(hi, 6) AS upper
FROM f""")
def q_iqr_bounds_value(spark, sf_dir):
    return round_doubles(CL.iqr_bounds_frame(events_na(spark, sf_dir), "value"))


@register("outlier_count_value", WITH_EVENTS_NA + _FENCES + """
SELECT count_if(value < lo OR value > hi)::BIGINT AS n_outliers FROM events_na, f""")
def q_outlier_count_value(spark, sf_dir):
    return CL.outlier_count(events_na(spark, sf_dir), "value")


@register("outliers_removed", WITH_EVENTS_NA + _FENCES + """
SELECT e.* FROM events_na e, f WHERE e.value IS NULL OR e.value BETWEEN f.lo AND f.hi""")
def q_outliers_removed(spark, sf_dir):
    return CL.treat_outliers(_ws_events_na(spark, sf_dir), "value", "remove").working()


@register("outliers_median", WITH_EVENTS_NA + _FENCES + """
SELECT event_id, user_id,
       round(CASE WHEN value < lo OR value > hi THEN (SELECT median(value) FROM events_na) ELSE value END, 6) AS value,
       event_type FROM events_na, f""")
def q_outliers_median(spark, sf_dir):
    return round_doubles(CL.treat_outliers(_ws_events_na(spark, sf_dir), "value", "median").working())


@register("outliers_mean", WITH_EVENTS_NA + _FENCES + """
SELECT event_id, user_id,
       round(CASE WHEN value < lo OR value > hi THEN (SELECT avg(value) FROM events_na) ELSE value END, 6) AS value,
       event_type FROM events_na, f""")
def q_outliers_mean(spark, sf_dir):
    return round_doubles(CL.treat_outliers(_ws_events_na(spark, sf_dir), "value", "mean").working())


# T1-T3 --------------------------------------------------------------------------------
_LI_SCALE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li_scale_ws(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_LI_SCALE)
    return Workspace.from_df(li)


@register("minmax_lineitem", "WITH s AS (SELECT " + ", ".join(
    f"min({c}) AS {c}_a, max({c}) AS {c}_b" for c in _LI_SCALE) + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - {c}_a) / nullif({c}_b - {c}_a, 0), 6) AS {c}" for c in _LI_SCALE) + " FROM lineitem, s")
def q_minmax_lineitem(spark, sf_dir):
    return round_doubles(SC.scale(_li_scale_ws(spark, sf_dir), _LI_SCALE, "minmax").working())


@register("zscore_lineitem", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_a, stddev_samp({c}) AS {c}_b" for c in _LI_SCALE) + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - {c}_a) / nullif({c}_b, 0), 6) AS {c}" for c in _LI_SCALE) + " FROM lineitem, s")
def q_zscore_lineitem(spark, sf_dir):
    return round_doubles(SC.scale(_li_scale_ws(spark, sf_dir), _LI_SCALE, "zscore").working())


@register("log_value", "SELECT event_id, round(ln(value + 1), 6) AS value FROM events")
def q_log_value(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "events").select("event_id", "value"), key="event_id")
    return round_doubles(SC.scale(ws, ["value"], "log").working())


@register("log_acctbal", """
SELECT c_custkey, round(CASE WHEN c_acctbal > -1 THEN ln(c_acctbal + 1)
                             WHEN c_acctbal = -1 THEN '-inf'::DOUBLE END, 6) AS c_acctbal FROM customer""")
def q_log_acctbal(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), key="c_custkey")
    return round_doubles(SC.scale(ws, ["c_acctbal"], "log").working())


# E1-E3 --------------------------------------------------------------------------------
@register("label_encode_priority", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS o_orderpriority FROM orders""")
def q_label_encode_priority(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), key="o_orderkey")
    return EN.encode(ws, ["o_orderpriority"], "label").working()


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("onehot_segment", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS c_mktsegment_{s}" for s in _SEGMENTS)
    + " FROM customer")
def q_onehot_segment(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), key="c_custkey")
    return EN.encode(ws, ["c_mktsegment"], "onehot").working()


@register("encode_remaining_orders", """
SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_orderstatus) AS o_orderstatus, o_totalprice,
       dense_rank() OVER (ORDER BY o_orderpriority) AS o_orderpriority FROM orders""")
def q_encode_remaining_orders(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "orders"), key="o_orderkey")
    ws = CV.drop_features(ws, ["o_orderdate"])
    return EN.encode_remaining(ws).working()


# A1-A4 --------------------------------------------------------------------------------
@register("hist_value", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin FROM events, s WHERE value IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT r.range AS bin, round(s.lo + r.range * ((s.hi - s.lo) / 10), 6) AS lower,
       round(s.lo + (r.range + 1) * ((s.hi - s.lo) / 10), 6) AS upper, coalesce(c.n, 0)::BIGINT AS count
FROM range(10) r CROSS JOIN s LEFT JOIN c ON c.bin = r.range""")
def q_hist_value(spark, sf_dir):
    return round_doubles(EX.histogram(table(spark, sf_dir, "events"), "value", bins=10))


@register("bar_event_type", """
SELECT event_type AS level, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def q_bar_event_type(spark, sf_dir):
    return EX.category_counts(table(spark, sf_dir, "events"), "event_type")


_BOX_SQL = """, q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM src),
f AS (SELECT q1, med, q3, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(lf, 6) AS lower_fence,
       round(uf, 6) AS upper_fence, round(min(CASE WHEN value >= lf THEN value END), 6) AS lower_whisker,
       round(max(CASE WHEN value <= uf THEN value END), 6) AS upper_whisker,
       count_if(value < lf OR value > uf)::BIGINT AS n_outliers
FROM src, f GROUP BY q1, med, q3, lf, uf"""


@register("box_value", "WITH src AS (SELECT value FROM events)" + _BOX_SQL)
def q_box_value(spark, sf_dir):
    return round_doubles(EX.box_stats(table(spark, sf_dir, "events"), "value"))


@register("pie_returnflag", """
SELECT l_returnflag AS level, count(*) AS count,
       round(count(*)::DOUBLE / (SELECT count(l_returnflag) FROM lineitem), 6) AS share
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def q_pie_returnflag(spark, sf_dir):
    return round_doubles(EX.category_shares(table(spark, sf_dir, "lineitem"), "l_returnflag"))


# B1-B9 --------------------------------------------------------------------------------
@register("scatter_binned", """
WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
s AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p),
b AS (SELECT least(floor((x - x0) / ((x1 - x0) / 20)), 19)::BIGINT AS bx,
             least(floor((y - y0) / ((y1 - y0) / 20)), 19)::BIGINT AS "by" FROM p, s)
SELECT bx, "by", round(x0 + bx * ((x1 - x0) / 20), 6) AS x_lower, round(y0 + "by" * ((y1 - y0) / 20), 6) AS y_lower,
       count(*) AS count FROM b, s GROUP BY bx, "by", x0, x1, y0, y1""")
def q_scatter_binned(spark, sf_dir):
    return round_doubles(EX.scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", bins=20))


@register("regline_price_qty", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) AS n FROM lineitem""")
def q_regline_price_qty(spark, sf_dir):
    df = EX.regression_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return df.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@register("corr_price_qty", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def q_corr_price_qty(spark, sf_dir):
    return EX.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", digits=6)


def _corr_matrix_sql(src: str, cols: list[str], where: str) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM c")
    return f"{src}, c AS (SELECT * FROM {where})\n" + "\nUNION ALL\n".join(parts)


_CM_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_matrix_lineitem", _corr_matrix_sql("WITH li AS (SELECT * FROM lineitem)", _CM_LI,
          "li WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CM_LI)))
def q_corr_matrix_lineitem(spark, sf_dir):
    return EX.corr_matrix(table(spark, sf_dir, "lineitem"), _CM_LI, digits=6)


_CM_EV = ["event_id", "user_id", "value"]


@register("corr_matrix_events_na", _corr_matrix_sql(WITH_EVENTS_NA.rstrip("\n"), _CM_EV,
          "events_na WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CM_EV)))
def q_corr_matrix_events_na(spark, sf_dir):
    return EX.corr_matrix(events_na(spark, sf_dir), _CM_EV, digits=6)


def _eta_sql(src: str, x: str, y: str) -> str:
    return src + f""", g AS (SELECT count(*) AS n_all, avg({y}) AS m, var_pop({y}) AS v FROM t),
l AS (SELECT {x}, count(*) AS n, avg({y}) AS ml FROM t WHERE {x} IS NOT NULL GROUP BY {x})
SELECT round(CASE WHEN bool_or(ml IS NULL) THEN NULL
                  ELSE sqrt((sum(n * (ml - m) * (ml - m)) / n_all) / nullif(v, 0)) END, 6) AS eta
FROM l, g GROUP BY n_all, v"""


@register("eta_flag_price", _eta_sql("WITH t AS (SELECT * FROM lineitem)", "l_returnflag", "l_extendedprice"))
def q_eta_flag_price(spark, sf_dir):
    return EX.correlation_ratio(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", digits=6)


@register("eta_events_na", _eta_sql(WITH_EVENTS_NA.rstrip("\n") + ", t AS (SELECT * FROM events_na)", "event_type", "value"))
def q_eta_events_na(spark, sf_dir):
    return EX.correlation_ratio(events_na(spark, sf_dir), "event_type", "value", digits=6)


@register("box_by_event_type", WITH_EVENTS_NA + """,
q AS (SELECT event_type AS level, quantile_cont(value, 0.25) AS q1, median(value) AS med,
             quantile_cont(value, 0.75) AS q3 FROM events_na GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.level, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(lf, 6) AS lower_fence,
       round(uf, 6) AS upper_fence, round(min(CASE WHEN value >= lf THEN value END), 6) AS lower_whisker,
       round(max(CASE WHEN value <= uf THEN value END), 6) AS upper_whisker,
       count_if(value < lf OR value > uf)::BIGINT AS n_outliers
FROM events_na e JOIN f ON e.event_type IS NOT DISTINCT FROM f.level
GROUP BY f.level, q1, med, q3, lf, uf""")
def q_box_by_event_type(spark, sf_dir):
    return round_doubles(EX.box_stats(events_na(spark, sf_dir), "value", by="event_type"))


_CT_SQL = """WITH p AS (SELECT l_returnflag AS x, l_linestatus AS y FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL),
lx AS (SELECT DISTINCT x FROM p), ly AS (SELECT DISTINCT y FROM p),
c AS (SELECT x, y, count(*) AS n FROM p GROUP BY x, y),
cells AS (SELECT lx.x, ly.y, coalesce(c.n, 0)::BIGINT AS count FROM lx CROSS JOIN ly LEFT JOIN c ON c.x = lx.x AND c.y = ly.y)
"""


@register("contingency_flag_status", _CT_SQL + "SELECT x AS l_returnflag, y AS l_linestatus, count FROM cells")
def q_contingency_flag_status(spark, sf_dir):
    return EX.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("profiles_flag_status", _CT_SQL + """SELECT x AS l_returnflag, y AS l_linestatus, count,
       round(count::DOUBLE / sum(count) OVER (PARTITION BY y), 6) AS proportion FROM cells""")
def q_profiles_flag_status(spark, sf_dir):
    return round_doubles(EX.column_profiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@register("cramers_v_events", """
WITH p AS (SELECT event_type AS x, (floor(value) % 3)::BIGINT AS y FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
lx AS (SELECT DISTINCT x FROM p), ly AS (SELECT DISTINCT y FROM p),
c AS (SELECT x, y, count(*) AS n FROM p GROUP BY x, y),
cells AS (SELECT lx.x, ly.y, coalesce(c.n, 0)::DOUBLE AS o FROM lx CROSS JOIN ly LEFT JOIN c ON c.x = lx.x AND c.y = ly.y),
e AS (SELECT o, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM cells)
SELECT round(sqrt(sum((o - e) * (o - e) / e) / (min(n) * (least((SELECT count(*) FROM lx), (SELECT count(*) FROM ly)) - 1))), 6)
       AS cramers_v FROM e""")
def q_cramers_v_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", (F.floor("value") % 3).alias("value_mod3"))
    return EX.cramers_v(ev, "event_type", "value_mod3", digits=6)


# R1 -----------------------------------------------------------------------------------
@register("select_target_orders", """
SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_orderstatus) AS o_orderstatus, o_totalprice,
       dense_rank() OVER (ORDER BY o_orderpriority) AS y, o_orderpriority AS y_label
FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
  AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q_select_target_orders(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "orders").drop("o_orderdate"), key="o_orderkey")
    return SA.select_target(ws, "o_orderpriority").working()


# R2-R3 --------------------------------------------------------------------------------
@register("downsample_priority", """
WITH t AS (SELECT o_orderkey, o_orderpriority FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                                   ORDER BY md5(concat('42', ':', o_orderkey::VARCHAR)), o_orderkey) AS rk FROM t),
m AS (SELECT min(n) AS mn FROM (SELECT count(*) AS n FROM t GROUP BY o_orderpriority))
SELECT o_orderkey, o_orderpriority FROM r, m WHERE rk <= mn""")
def q_downsample_priority(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return SA.downsample(t, "o_orderpriority", key="o_orderkey", seed=42)


@register("upsample_status", """
WITH t AS (SELECT o_orderkey, o_orderstatus FROM orders),
c AS (SELECT o_orderstatus, count(*) AS n FROM t GROUP BY 1),
m AS (SELECT max(n) AS mx FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
                                   ORDER BY md5(concat('42', ':', o_orderkey::VARCHAR)), o_orderkey) AS rk FROM t),
d0 AS (SELECT o_orderstatus, n, unnest(range(1, mx - n + 1)) AS draw FROM c, m),
d AS (SELECT o_orderstatus, draw,
             1 + (('0x' || substr(md5(concat('42', ':', o_orderstatus, ':', draw::VARCHAR)), 1, 15))::BIGINT % n) AS idx
      FROM d0)
SELECT o_orderkey, o_orderstatus, 0::BIGINT AS draw FROM t
UNION ALL
SELECT r.o_orderkey, r.o_orderstatus, d.draw::BIGINT FROM d JOIN r ON r.o_orderstatus = d.o_orderstatus AND r.rk = d.idx""")
def q_upsample_status(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SA.upsample(t, "o_orderstatus", key="o_orderkey", seed=42)


# H1-H2 --------------------------------------------------------------------------------
@register("holdout_events", """
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('123', ':', event_id::VARCHAR)), event_id)
                           <= floor(0.7::DOUBLE * (SELECT count(*) FROM events)) THEN 'train' ELSE 'test' END AS split
FROM events""")
def q_holdout_events(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id")
    return SA.holdout(t, key="event_id", train=0.7, seed=123)


@register("split_report_orders", """
WITH s AS (SELECT o_orderstatus, CASE WHEN row_number() OVER (ORDER BY md5(concat('123', ':', o_orderkey::VARCHAR)), o_orderkey)
                           <= floor(0.7::DOUBLE * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS split
           FROM orders)
SELECT split, o_orderstatus AS level, count(*) AS count FROM s GROUP BY 1, 2""")
def q_split_report_orders(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SA.split_report(SA.holdout(t, key="o_orderkey", train=0.7, seed=123), y="o_orderstatus")


# L0 -----------------------------------------------------------------------------------
@register("candidate_models_totalprice", """
SELECT count(DISTINCT o_totalprice) AS n_distinct,
       CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'regression' ELSE 'classification' END AS task,
       CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'linear_regression,decision_tree'
            ELSE 'random_forest,svm' END AS models FROM orders""")
def q_candidate_models_totalprice(spark, sf_dir):
    return SA.candidate_models(table(spark, sf_dir, "orders"), "o_totalprice")


@register("candidate_models_status", """
SELECT count(DISTINCT o_orderstatus) AS n_distinct, 'classification' AS task, 'random_forest,svm' AS models
FROM orders""")
def q_candidate_models_status(spark, sf_dir):
    return SA.candidate_models(table(spark, sf_dir, "orders"), "o_orderstatus")


# V1-V8 on rule-based predictions -------------------------------------------------------
PRED_CLASS_SQL = """SELECT l_returnflag AS actual,
   CASE WHEN l_quantity > 40 THEN 'R' WHEN l_quantity > 15 THEN 'N' ELSE 'A' END AS predicted FROM lineitem"""
PRED_VALUE_SQL = "SELECT l_extendedprice AS actual, CAST(2000 AS DOUBLE) * l_quantity AS predicted FROM lineitem"
PRED_SCORE_SQL = "SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS actual, l_quantity AS score FROM lineitem"
PRED_PROBS_SQL = "SELECT l_returnflag AS actual, l_discount AS p_A, l_tax AS p_N, l_quantity / 50.0 AS p_R FROM lineitem"


def pred_class(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select(F.col("l_returnflag").alias("actual"),
                     F.when(q > 40, "R").when(q > 15, "N").otherwise("A").alias("predicted"))


def pred_value(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_extendedprice").alias("actual"), (F.lit(2000.0) * F.col("l_quantity")).alias("predicted"))


def pred_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("actual"), F.col("l_quantity").alias("score"))


def pred_probs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("actual"), F.col("l_discount").alias("p_A"),
                     F.col("l_tax").alias("p_N"), (F.col("l_quantity") / F.lit(50.0)).alias("p_R"))


def _metric_rounding(df: DataFrame, digits: dict) -> DataFrame:
    v = F.col("value")
    expr = None
    for m, d in digits.items():
        expr = F.when(F.col("metric") == m, F.round(v, d)) if expr is None else expr.when(F.col("metric") == m, F.round(v, d))
    rest = F.round(v, 6)
    return df.select("metric", (expr.otherwise(rest) if expr is not None else rest).alias("value"))


@register("regression_metrics_rule", "WITH pv AS (" + PRED_VALUE_SQL + """),
s AS (SELECT count(*) AS n, sum((actual - predicted) * (actual - predicted)) AS sse,
             var_pop(actual) * count(*) AS sst FROM pv)
SELECT 'RMSE' AS metric, round(sqrt(sse / n), 4) AS value FROM s
UNION ALL SELECT 'MSE', round(sse / n, 0) FROM s
UNION ALL SELECT 'R2', round(1 - sse / sst, 6) FROM s
UNION ALL SELECT 'Adjusted_R2', round(1 - (1 - (1 - sse / sst)) * (n - 1) / (n - 1 - 1), 6) FROM s""")
def q_regression_metrics_rule(spark, sf_dir):
    return _metric_rounding(EV.regression_metrics(pred_value(spark, sf_dir), p=1), {"RMSE": 4, "MSE": 0})


@register("classification_metrics_rule", "WITH pc AS (" + PRED_CLASS_SQL + """),
labels AS (SELECT actual AS label FROM pc UNION SELECT predicted FROM pc),
n AS (SELECT count(*)::DOUBLE AS n FROM pc),
per AS (SELECT l.label, count_if(pc.actual = l.label AND pc.predicted = l.label)::DOUBLE AS tp,
               count_if(pc.actual = l.label)::DOUBLE AS act, count_if(pc.predicted = l.label)::DOUBLE AS pred
        FROM labels l CROSS JOIN pc GROUP BY l.label),
m AS (SELECT tp, coalesce(tp / nullif(pred, 0), 0) AS prec, coalesce(tp / nullif(act, 0), 0) AS rec,
             coalesce((n - act - pred + tp) / nullif(n - act, 0), 0) AS spec FROM per, n),
f AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 FROM m)
SELECT 'Accuracy' AS metric, round(sum(tp) / (SELECT n FROM n), 6) AS value FROM f
UNION ALL SELECT 'Precision', round(avg(prec), 6) FROM f
UNION ALL SELECT 'Recall', round(avg(rec), 6) FROM f
UNION ALL SELECT 'Specificity', round(avg(spec), 6) FROM f
UNION ALL SELECT 'F1', round(avg(f1), 6) FROM f""")
def q_classification_metrics_rule(spark, sf_dir):
    return _metric_rounding(EV.classification_metrics(pred_class(spark, sf_dir)), {})


@register("confusion_rule", "WITH pc AS (" + PRED_CLASS_SQL + """),
labels AS (SELECT actual AS label FROM pc UNION SELECT predicted FROM pc),
c AS (SELECT predicted, actual, count(*) AS n FROM pc GROUP BY 1, 2)
SELECT p.label AS predicted, a.label AS actual, coalesce(c.n, 0)::BIGINT AS count
FROM labels p CROSS JOIN labels a LEFT JOIN c ON c.predicted = p.label AND c.actual = a.label""")
def q_confusion_rule(spark, sf_dir):
    return EV.confusion_matrix(pred_class(spark, sf_dir))


@register("actual_predicted_rule", "SELECT actual, predicted FROM (" + PRED_VALUE_SQL + ")")
def q_actual_predicted_rule(spark, sf_dir):
    return EV.actual_vs_predicted(pred_value(spark, sf_dir))


@register("residuals_rule", "SELECT round(predicted, 6) AS predicted, round(actual - predicted, 6) AS residual FROM ("
          + PRED_VALUE_SQL + ")")
def q_residuals_rule(spark, sf_dir):
    return round_doubles(EV.residuals(pred_value(spark, sf_dir)))


@register("roc_points_rule", "WITH ps AS (" + PRED_SCORE_SQL + """),
s AS (SELECT score::DOUBLE AS score, sum(actual) AS pos, sum(1 - actual) AS neg FROM ps GROUP BY 1),
t AS (SELECT sum(pos)::DOUBLE AS P, sum(neg)::DOUBLE AS N FROM s),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM s)
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT score, round(cn / N, 6), round(cp / P, 6) FROM c, t""")
def q_roc_points_rule(spark, sf_dir):
    return round_doubles(EV.roc_curve(pred_score(spark, sf_dir)))


@register("auc_rule", "WITH ps AS (" + PRED_SCORE_SQL + """),
s AS (SELECT score::DOUBLE AS score, sum(actual) AS pos, sum(1 - actual) AS neg FROM ps GROUP BY 1),
c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM s)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM c""")
def q_auc_rule(spark, sf_dir):
    return round_doubles(EV.auc(pred_score(spark, sf_dir)))


@register("auc_auto_direction", "WITH ps AS (SELECT actual, -score AS score FROM (" + PRED_SCORE_SQL + """)),
m AS (SELECT median(score::DOUBLE) FILTER (actual = 0) > median(score::DOUBLE) FILTER (actual = 1) AS lower FROM ps),
s AS (SELECT CASE WHEN lower THEN -score ELSE score END::DOUBLE AS score, sum(actual) AS pos, sum(1 - actual) AS neg
      FROM ps, m GROUP BY 1),
c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM s)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM c""")
def q_auc_auto_direction(spark, sf_dir):
    reversed_ = pred_score(spark, sf_dir).select("actual", (-F.col("score")).alias("score"))
    return round_doubles(EV.auc(reversed_, direction="auto"))


_AUC_MC_SQL = "WITH pp AS (" + PRED_PROBS_SQL + """),
st AS (SELECT 'A' AS cls, CASE WHEN actual = 'A' THEN 1 ELSE 0 END AS truth, p_A AS score FROM pp
       UNION ALL SELECT 'N', CASE WHEN actual = 'N' THEN 1 ELSE 0 END, p_N FROM pp
       UNION ALL SELECT 'R', CASE WHEN actual = 'R' THEN 1 ELSE 0 END, p_R FROM pp),
s AS (SELECT cls, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM st WHERE score IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score) - neg AS below FROM s),
a AS (SELECT cls, sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM c GROUP BY cls)
"""


@register("auc_per_class_rule", _AUC_MC_SQL + "SELECT cls, round(auc, 6) AS auc FROM a")
def q_auc_per_class_rule(spark, sf_dir):
    return round_doubles(EV.auc_per_class(pred_probs(spark, sf_dir), "actual", {"A": "p_A", "N": "p_N", "R": "p_R"}))


@register("auc_multiclass_rule", _AUC_MC_SQL + "SELECT round(avg(auc), 6) AS auc FROM a")
def q_auc_multiclass_rule(spark, sf_dir):
    return EV.auc_multiclass(pred_probs(spark, sf_dir), "actual", {"A": "p_A", "N": "p_N", "R": "p_R"}, digits=6)


@register("corr_matrix_constant_column", """
WITH c AS (SELECT l_quantity, 1.0::DOUBLE AS one FROM lineitem WHERE l_quantity IS NOT NULL),
v AS (SELECT var_pop(l_quantity) > 0 AS varies, var_pop(one) > 0 AS one_varies FROM c)
SELECT 'one' AS x, 'one' AS y, round(CASE WHEN one_varies THEN corr(one, one) ELSE 1.0 END, 6) AS r
FROM c, v GROUP BY one_varies
UNION ALL SELECT 'l_quantity', 'l_quantity', round(corr(l_quantity, l_quantity), 6) FROM c
UNION ALL SELECT 'l_quantity', 'one', CASE WHEN varies AND one_varies THEN corr(l_quantity, one) END FROM c, v
          GROUP BY varies, one_varies""")
def q_corr_matrix_constant_column(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.lit(1.0).alias("one"))
    return EX.corr_matrix(rows, ["l_quantity", "one"], digits=6)


_WIDE = 61


def _wide_sql() -> str:
    cols = ", ".join(f"((l_orderkey * {i} + l_partkey) % 97 + l_quantity / {i})::DOUBLE AS c{i}" for i in range(1, _WIDE + 1))
    cells = ", ".join(f"{{'x': 'c{i}', 'y': 'c{j}', 'r': round(corr(c{i}, c{j}), 6)}}"
                      for i in range(1, _WIDE + 1) for j in range(i, _WIDE + 1))
    return f"WITH w AS (SELECT {cols} FROM lineitem)\nSELECT unnest([{cells}], recursive := true) FROM w"


@register("corr_matrix_61_columns", _wide_sql())
def q_corr_matrix_61_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[
        ((F.col("l_orderkey") * i + F.col("l_partkey")) % 97 + F.col("l_quantity") / i).cast("double").alias(f"c{i}")
        for i in range(1, _WIDE + 1)])
    return EX.corr_matrix(rows, digits=6)


# quantiles of values of any spread ------------------------------------------------------
_SPREAD_PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@register("quantiles_wide_spread", """
WITH x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * power(10.0::DOUBLE, l_orderkey % 499 - 250) AS v
           FROM lineitem),
r AS (SELECT v, row_number() OVER (ORDER BY v) AS rank, count(*) OVER () AS n FROM x),
p AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS prob),
a AS (SELECT prob, (n - 1) * prob AS pos, max(v) FILTER (rank = floor((n - 1) * prob) + 1) AS lo,
             max(v) FILTER (rank = ceil((n - 1) * prob) + 1) AS hi FROM r, p GROUP BY prob, n),
q AS (SELECT prob, CASE WHEN floor(pos) = ceil(pos) THEN lo ELSE (ceil(pos) - pos) * lo + (pos - floor(pos)) * hi END AS v
      FROM a)
SELECT prob, sign(v)::DOUBLE AS sign, round(log10(abs(v)), 6) AS magnitude FROM q""")
def q_quantiles_wide_spread(spark, sf_dir):
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    x = table(spark, sf_dir, "lineitem").select((sign * F.pow(F.lit(10.0), F.col("l_orderkey") % 499 - 250)).alias("v"))
    q = quantiles(x, "v", _SPREAD_PROBS, names=[f"q{i}" for i in range(len(_SPREAD_PROBS))])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"q{i}").alias("v"))
                               for i, p in enumerate(_SPREAD_PROBS)]))
    return q.select(rows.alias("r")).select("r.prob", F.signum("r.v").alias("sign"),
                                            F.round(F.log10(F.abs("r.v")), 6).alias("magnitude"))


_INF_SQL = """WITH x AS (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'Infinity'::DOUBLE
                                  WHEN event_id % 5 = 1 THEN '-Infinity'::DOUBLE ELSE value END AS v FROM events),
r AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) AS rank,
             count(*) OVER (PARTITION BY event_type) AS n FROM x WHERE v IS NOT NULL)
"""


@register("quantiles_with_infinity", _INF_SQL + """
SELECT event_type, max(v) FILTER (rank = (n - 1) // 10 + 1)::VARCHAR AS low,
       round(max(v) FILTER (rank = (n - 1) // 2 + 1), 6) AS mid,
       max(v) FILTER (rank = n)::VARCHAR AS high FROM r GROUP BY event_type""")
def q_quantiles_with_infinity(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 5 == 0, F.lit(float("inf")))
                                              .when(F.col("event_id") % 5 == 1, F.lit(float("-inf")))
                                              .otherwise(F.col("value")).alias("v"))
    sizes = {r[0]: r[1] for r in x.where(F.col("v").isNotNull()).groupBy("event_type").count().collect()}
    got = kth_smallest(x, "v", {g: [(n - 1) // 10 + 1, (n - 1) // 2 + 1, n] for g, n in sizes.items()}, by="event_type")

    def text(v: float) -> str:
        return {float("inf"): "inf", float("-inf"): "-inf"}.get(v, str(v))
    rows = [(g, text(got[(g, (n - 1) // 10 + 1)]), round(got[(g, (n - 1) // 2 + 1)], 6), text(got[(g, n)]))
            for g, n in sizes.items()]
    return spark.createDataFrame(rows, "event_type string, low string, mid double, high string")


@register("box_by_all_null_group", """
WITH t AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS level,
                  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events),
q AS (SELECT level, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3
      FROM t GROUP BY level),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.level, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(lf, 6) AS lower_fence,
       round(uf, 6) AS upper_fence, round(min(CASE WHEN value >= lf THEN value END), 6) AS lower_whisker,
       round(max(CASE WHEN value <= uf THEN value END), 6) AS upper_whisker,
       coalesce(count_if(value < lf OR value > uf), 0)::BIGINT AS n_outliers
FROM t JOIN f ON t.level IS NOT DISTINCT FROM f.level GROUP BY f.level, q1, med, q3, lf, uf""")
def q_box_by_all_null_group(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select(F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("level"),
                 F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return round_doubles(EX.box_stats(t, "value", by="level"))


@register("box_by_customer", """
WITH t AS (SELECT o_custkey AS level, o_totalprice AS value FROM orders),
q AS (SELECT level, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3
      FROM t GROUP BY level),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.level, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(lf, 6) AS lower_fence,
       round(uf, 6) AS upper_fence, round(min(CASE WHEN value >= lf THEN value END), 6) AS lower_whisker,
       round(max(CASE WHEN value <= uf THEN value END), 6) AS upper_whisker,
       count_if(value < lf OR value > uf)::BIGINT AS n_outliers
FROM t JOIN f USING (level) GROUP BY f.level, q1, med, q3, lf, uf""")
def q_box_by_customer(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("level"), F.col("o_totalprice").alias("value"))
    return round_doubles(EX.box_stats(t, "value", by="level"))


@register("cramers_v_priority_customer", """
WITH p AS (SELECT o_orderpriority AS x, o_custkey::VARCHAR AS y, count(*) AS n FROM orders
           WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 2),
r AS (SELECT x, sum(n) AS rt FROM p GROUP BY x), c AS (SELECT y, sum(n) AS ct FROM p GROUP BY y),
k AS (SELECT least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1 AS k, (SELECT sum(n) FROM p) AS t)
SELECT round(sqrt(sum((coalesce(n, 0) - rt * ct / t::DOUBLE) ** 2 / (rt * ct / t::DOUBLE)) / (any_value(t) * any_value(k))), 6)
       AS cramers_v
FROM r CROSS JOIN c LEFT JOIN p USING (x, y) CROSS JOIN k""")
def q_cramers_v_priority_customer(spark, sf_dir):
    t = table(spark, sf_dir, "orders").withColumn("customer", F.col("o_custkey").cast("string"))
    return EX.cramers_v(t, "o_orderpriority", "customer", digits=6)


# L4 / recipes -------------------------------------------------------------------------
@register("linreg_simple", """
SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 6) FROM lineitem""")
def q_linreg_simple(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    fm = MO.train(li, "linear_regression", ["l_quantity"], label="l_extendedprice")
    lr = fm.pipeline.stages[-1]
    rows = [("intercept", float(lr.intercept)), ("l_quantity", float(lr.coefficients[0]))]
    res = spark.createDataFrame(rows, "term string, estimate double")
    return res.select("term", F.when(F.col("term") == "intercept", F.round("estimate", 4))
                      .otherwise(F.round("estimate", 6)).alias("estimate"))


# Models on targets whose fitted result is known: a depth-1 tree gives group means, a logistic regression on a two-valued
# feature the groups' shares, and classes that one feature separates are predicted without error.
_STATUS_SQL = "SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS f, o_totalprice AS y FROM orders"


def _status(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("f"), F.col("o_totalprice").alias("y"))


@register("tree_group_means", f"SELECT f, round(avg(y), 4) AS predicted, count(*) AS n FROM ({_STATUS_SQL}) GROUP BY f")
def q_tree_group_means(spark, sf_dir):
    rows = _status(spark, sf_dir)
    pred = MO.predict(MO.train(rows, "decision_tree", ["f"], label="y", max_depth=1), rows)
    return pred.groupBy("f", F.round("predicted", 4).alias("predicted")).agg(F.count("*").alias("n"))


@register("tree_metrics", f"""
WITH t AS ({_STATUS_SQL}), g AS (SELECT f, avg(y) AS m FROM t GROUP BY f),
e AS (SELECT sum((y - m) ** 2) AS sse, count(*) AS n FROM t JOIN g USING (f)),
v AS (SELECT sum((y - a) ** 2) AS sst FROM t, (SELECT avg(y) AS a FROM t)),
m AS (SELECT sse / n AS mse, 1 - sse / sst AS r2, n FROM e, v)
SELECT 'RMSE' AS metric, round(sqrt(mse), 4) AS value FROM m UNION ALL SELECT 'MSE', round(mse, 1) FROM m
UNION ALL SELECT 'R2', round(r2, 6) FROM m UNION ALL SELECT 'Adjusted_R2', round(1 - (1 - r2) * (n - 1) / (n - 2), 6) FROM m""")
def q_tree_metrics(spark, sf_dir):
    rows = _status(spark, sf_dir)
    got = MO.evaluate(MO.train(rows, "decision_tree", ["f"], label="y", max_depth=1), rows)
    digits = F.when(F.col("metric") == "MSE", F.round("value", 1)).when(F.col("metric") == "RMSE", F.round("value", 4))
    return got.select("metric", digits.otherwise(F.round("value", 6)).alias("value"))


@register("logistic_group_shares", """
SELECT user_id % 2 AS f, round(avg((event_type IN ('click', 'view'))::INT), 3) AS prob_1, count(*) AS n
FROM events GROUP BY 1""")
def q_logistic_group_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 2).alias("f"), F.col("event_type").isin("click", "view").cast("int").alias("y"))
    pred = MO.predict(MO.train(rows, "logistic_regression", ["f"], label="y"), rows)
    return pred.groupBy("f", F.round("prob_1", 3).alias("prob_1")).agg(F.count("*").alias("n"))


_PARTS_SQL = """SELECT CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS two,
       CASE WHEN l_linenumber <= 2 THEN 'a' WHEN l_linenumber <= 4 THEN 'b' ELSE 'c' END AS three FROM lineitem"""


def _parts(spark, sf_dir) -> DataFrame:
    high, n = F.col("l_quantity") > 25, F.col("l_linenumber")
    three = F.when(n <= 2, "a").when(n <= 4, "b").otherwise("c")
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", F.when(high, "high").otherwise("low").alias("two"), three.alias("three"),
        F.when(high, 1.0).otherwise(-1.0).alias("side"), (three == "a").cast("double").alias("is_a"),
        (three == "b").cast("double").alias("is_b"))


def _predicted(spark, sf_dir, model: str, features: list[str], label: str, **kw) -> DataFrame:
    rows = _parts(spark, sf_dir)
    pred = MO.predict(MO.train(rows, model, features, label=label, **kw), rows, keep=[label])
    return pred.groupBy(F.col(label).alias("actual"), "predicted").agg(F.count("*").alias("n"))


_TWO = f"SELECT two AS actual, two AS predicted, count(*) AS n FROM ({_PARTS_SQL}) GROUP BY two"
_THREE = f"SELECT three AS actual, three AS predicted, count(*) AS n FROM ({_PARTS_SQL}) GROUP BY three"


@register("forest_separable", _TWO)
def q_forest_separable(spark, sf_dir):
    return _predicted(spark, sf_dir, "random_forest", ["l_quantity"], "two", trees=5, max_depth=3)


@register("svm_separable", _TWO)
def q_svm_separable(spark, sf_dir):
    return _predicted(spark, sf_dir, "svm", ["side", "l_discount"], "two", max_iter=20)


@register("svm_cubic_separable", _TWO)
def q_svm_cubic_separable(spark, sf_dir):
    return _predicted(spark, sf_dir, "svm", ["side", "l_discount"], "two", kernel="polynomial", C=1.0, max_iter=20,
                      probability=False)


@register("svm_pairs_separable", _THREE)
def q_svm_pairs_separable(spark, sf_dir):
    return _predicted(spark, sf_dir, "svm", ["is_a", "is_b"], "three", strategy="ovo", C=1.0, max_iter=20, probability=False)


@register("linear_importance", """
WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb,
                  covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay,
                  covar_pop(l_discount, l_extendedprice) AS b_y FROM lineitem),
w AS (SELECT (bb * ay - ab * b_y) / (aa * bb - ab * ab) AS q, (aa * b_y - ab * ay) / (aa * bb - ab * ab) AS d FROM c)
SELECT 'l_quantity' AS feature, round(q, 4) AS importance, round(abs(q), 4) AS abs_importance FROM w
UNION ALL SELECT 'l_discount', round(d, 4), round(abs(d), 4) FROM w""")
def q_linear_importance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    fm = MO.train(rows, "linear_regression", ["l_quantity", "l_discount"], label="l_extendedprice")
    return round_doubles(MO.feature_importance(fm), 4)


@register("tree_importance", f"""
WITH t AS (SELECT l_quantity, l_linenumber * 0 AS none FROM lineitem),
v AS (SELECT CASE WHEN var_pop(l_quantity) > 0 THEN 1.0 ELSE 0.0 END AS q, CASE WHEN var_pop(none) > 0 THEN 1.0 ELSE 0.0 END AS z
      FROM t),
m AS (SELECT unnest(['decision_tree', 'random_forest']) AS model)
SELECT model, 'l_quantity' AS feature, q::DOUBLE AS importance FROM v, m
UNION ALL SELECT model, 'none', z::DOUBLE FROM v, m""")
def q_tree_importance(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumn("none", F.col("l_discount") * 0)
    out = []
    for model, kw in (("decision_tree", {}), ("random_forest", {"trees": 5})):
        fm = MO.train(rows, model, ["l_quantity", "none"], label="two", max_depth=2, **kw)
        out.append(MO.feature_importance(fm).select(F.lit(model).alias("model"), "feature", "importance"))
    return out[0].union(out[1])


@register("recipe_regression")
def q_recipe_regression(spark, sf_dir):
    return RC.regression_flow(spark, sf_dir)


@register("recipe_multiclass")
def q_recipe_multiclass(spark, sf_dir):
    return RC.multiclass_flow(spark, sf_dir)


@register("recipe_binary")
def q_recipe_binary(spark, sf_dir):
    return RC.binary_flow(spark, sf_dir)


# More operator paths under the oracle ---------------------------------------------------
@register("unscale_log_value", "SELECT event_id, round(exp(ln(value + 1)) - 1, 6) AS value FROM events")
def q_unscale_log_value(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "events").select("event_id", "value"), key="event_id")
    return round_doubles(SC.unscale(SC.scale(ws, ["value"], "log"), ["value"]).working())


_EV_FENCES = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


@register("outlier_points_value", _EV_FENCES + "SELECT e.* FROM events e, f WHERE e.value < f.lo OR e.value > f.hi")
def q_outlier_points_value(spark, sf_dir):
    return EX.outlier_points(table(spark, sf_dir, "events"), "value")


@register("flag_outliers_value", _EV_FENCES + """
SELECT event_id, coalesce(value < lo OR value > hi, false) AS is_outlier FROM events, f""")
def q_flag_outliers_value(spark, sf_dir):
    return CL.flag_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value").drop("value")


@register("describe_event_type", WITH_EVENTS_NA + "SELECT event_type AS level, count(*) AS count FROM events_na GROUP BY 1")
def q_describe_event_type(spark, sf_dir):
    return P.describe_one(events_na(spark, sf_dir), "event_type")


@register("scatter_pairs", """
SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def q_scatter_pairs(spark, sf_dir):
    return EX.scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("onehot_event_type_na", WITH_EVENTS_NA + "SELECT event_id, " + ", ".join(
    f"CASE WHEN event_type = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS event_type_{t}" for t in _EVENT_TYPES)
    + " FROM events_na")
def q_onehot_event_type_na(spark, sf_dir):
    ws = Workspace.from_df(events_na(spark, sf_dir).select("event_id", "event_type"), key="event_id")
    return EN.encode(ws, ["event_type"], "onehot").working()


@register("label_encode_event_type_na", WITH_EVENTS_NA + """
SELECT event_id, CASE WHEN event_type IS NULL THEN NULL
                      ELSE dense_rank() OVER (ORDER BY event_type NULLS LAST) END AS event_type FROM events_na""")
def q_label_encode_event_type_na(spark, sf_dir):
    ws = Workspace.from_df(events_na(spark, sf_dir).select("event_id", "event_type"), key="event_id")
    return EN.encode(ws, ["event_type"], "label").working()


@register("cat_to_num_restore_size", "SELECT p_partkey, p_size FROM part")
def q_cat_to_num_restore_size(spark, sf_dir):
    ws = Workspace.from_df(table(spark, sf_dir, "part").select("p_partkey", "p_size"), key="p_partkey")
    ws, _converted, _failed = CV.cat_to_num(CV.num_to_cat(ws, ["p_size"]), ["p_size"])
    return ws.working()


@register("hist_value_binwidth", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, CAST(ceil((max(value) - min(value)) / 50.0) AS BIGINT) AS nb
           FROM events),
b AS (SELECT least(floor((value - lo) / 50.0), nb - 1)::BIGINT AS bin FROM events, s WHERE value IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT unnest(range(0, nb)) AS bin FROM s)
SELECT g.bin, round(s.lo + g.bin * 50.0, 6) AS lower, round(s.lo + (g.bin + 1) * 50.0, 6) AS upper,
       coalesce(c.n, 0)::BIGINT AS count FROM g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")
def q_hist_value_binwidth(spark, sf_dir):
    return round_doubles(EX.histogram(table(spark, sf_dir, "events"), "value", binwidth=50.0))
