"""Missing values (M1-M5) and outliers (O1-O4).

Statistics come from the raw (display) column; the change is written to both
copies (same rows, same constant), as in the reference.  Each statistic is one
aggregate whose value is inlined as a literal, so the row-level step is a
narrow projection or a filter that Parquet can use for row-group skipping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import quantile_values
from ..functions.stats import col, complete_rows, is_numeric, lit_or_null, one_row
from ..fixed import IQR_FACTOR
from ..workspace import Workspace

METHODS = ("drop", "mode", "median", "mean")


def mode_value(df: DataFrame, c: str):
    """Most frequent non-NULL value; ties -> the smallest value.

    Distributed count per value (partial aggregation absorbs a hot value),
    then a top-1 (TakeOrderedAndProject): no value list reaches the driver.
    """
    top = (df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count("*").alias("n"))
           .orderBy(F.col("n").desc(), F.col("v").asc()).limit(1).collect())
    return top[0]["v"] if top else None


def center_value(df: DataFrame, c: str, method: str):
    if method == "mean":
        return one_row(df, [F.avg(col(c).cast("double")).alias("m")])["m"]
    if method == "median":
        return quantile_values(df, c, [0.5])[0]
    if method == "mode":
        return mode_value(df, c)
    raise ValueError(f"unknown statistic {method!r}")


# M1-M4 --------------------------------------------------------------------------------
def impute(ws: Workspace, column: str, method: str) -> Workspace:
    """Treat missing values of one column: drop rows, or fill with mode / median / mean."""
    ws.check_open()
    ws.require([column])
    if method not in METHODS:
        raise ValueError(f"unknown missing-value method {method!r}; one of {METHODS}")
    raw = col(column)
    if method in ("median", "mean") and not is_numeric(ws.df, column):
        raise ValueError(f"{method} imputation needs a numeric column; {column!r} is not")
    if one_row(ws.df, [F.count_if(raw.isNull()).alias("n")])["n"] == 0:
        return ws  # no missing value: no-op
    if method == "drop":
        return ws.evolve(ws.df.where(raw.isNotNull()))
    value = center_value(ws.display(), column, method)
    if value is None:
        return ws
    if method in ("median", "mean"):
        raw_type = work_type = "double"  # an integer column becomes double, as in R
    else:
        raw_type = ws.df.schema[column].dataType.simpleString()
        work_type = ws.df.schema[ws.wcol(column)].dataType.simpleString() if column in ws.work else raw_type
    if method == "mode" and "encoded" in ws.tags.get(column, ()) and column in ws.work and not ws.shared(column):
        # the working copy holds codes: fill it with the code that stands beside the mode
        code = one_row(ws.df, [F.min(F.when(raw == F.lit(value), col(ws.wcol(column)))).alias("code")])["code"]
        return ws.apply(raw={column: lambda x: F.coalesce(x, F.lit(value).cast(raw_type))},
                        work={column: lambda x: F.coalesce(x, F.lit(code).cast(work_type))})
    if column in ws.work:
        ws.warn_if_transformed(column, "imputation")
    if ws.shared(column) or column not in ws.work or raw_type == work_type:
        fill = F.lit(value).cast(raw_type)
        return ws.apply(both={column: lambda x: F.coalesce(x.cast(raw_type), fill)})
    return ws.apply(raw={column: lambda x: F.coalesce(x.cast(raw_type), F.lit(value).cast(raw_type))},
                    work={column: lambda x: F.coalesce(x.cast(work_type), F.lit(value).cast(work_type))})


# M5 -----------------------------------------------------------------------------------
def na_omit(df: DataFrame, subset=None) -> DataFrame:
    """Listwise deletion: drop every row with a missing value (NaN too)."""
    return complete_rows(df, subset)


# O1 -----------------------------------------------------------------------------------
def iqr_bounds(df: DataFrame, c: str) -> dict:
    """q1, q3 (type 7), IQR and the 1.5*IQR fences of a numeric column."""
    if not is_numeric(df, c):
        raise ValueError(f"outlier detection needs a numeric column; {c!r} is not")
    q1, q3 = quantile_values(df, c, [0.25, 0.75])
    if q1 is None:
        return {"q1": None, "q3": None, "iqr": None, "lower": None, "upper": None}
    iqr = q3 - q1
    return {"q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - IQR_FACTOR * iqr, "upper": q3 + IQR_FACTOR * iqr}


def iqr_bounds_frame(df: DataFrame, c: str) -> DataFrame:
    b = iqr_bounds(df, c)
    return df.sparkSession.createDataFrame(
        [(b["q1"], b["q3"], b["iqr"], b["lower"], b["upper"])],
        "q1 double, q3 double, iqr double, lower double, upper double")


def outlier_condition(c: str, bounds: dict):
    """Strictly outside the fences; NULL is never an outlier."""
    x = col(c)
    return F.coalesce((x < F.lit(bounds["lower"])) | (x > F.lit(bounds["upper"])), F.lit(False))


def flag_outliers(df: DataFrame, c: str, flag: str = "is_outlier") -> DataFrame:
    b = iqr_bounds(df, c)
    if b["q1"] is None:
        return df.withColumn(flag, F.lit(False))
    return df.withColumn(flag, outlier_condition(c, b))


def outlier_count(df: DataFrame, c: str) -> DataFrame:
    b = iqr_bounds(df, c)
    cond = outlier_condition(c, b) if b["q1"] is not None else F.lit(False)
    return df.agg(F.count_if(cond).alias("n_outliers"))


# O2-O4 --------------------------------------------------------------------------------
def treat_outliers(ws: Workspace, column: str, method: str) -> Workspace:
    """remove | median | mean, with the fences and the statistic from the raw column (outliers included)."""
    ws.check_open()
    ws.require([column])
    if method not in ("remove", "median", "mean"):
        raise ValueError(f"unknown outlier method {method!r}")
    b = iqr_bounds(ws.display(), column)
    if b["q1"] is None:
        return ws
    is_out = outlier_condition(column, b)
    if one_row(ws.df, [F.count_if(is_out).alias("n")])["n"] == 0:
        return ws  # zero outliers: unchanged
    if method == "remove":
        # keep NULLs and values inside the fences: a range predicate Parquet can use
        x = col(column)
        return ws.evolve(ws.df.where(x.isNull() | x.between(F.lit(b["lower"]), F.lit(b["upper"]))))
    value = center_value(ws.display(), column, method)
    fill = lit_or_null(value)
    if column in ws.work:
        ws.warn_if_transformed(column, "outlier replacement")
    return ws.apply(both={column: lambda x: F.when(is_out, fill).otherwise(x.cast("double"))})
