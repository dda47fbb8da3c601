"""Profile and metadata (P1-P9) and table browsing (S6).

All per-column statistics of a profile are computed in one aggregate pass;
only the one-row result (bounded by the number of columns) reaches the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session as S
from ..fixed import PAGE_SIZE, QUALITATIVE_MAX_DISTINCT, SUMMARY_DECIMALS, TARGET_DECIMALS
from ..functions.quantile import multi_quantiles, quantiles
from ..functions.stats import (col, distinct_counts, exceeds_distinct, is_factor, is_numeric, is_string, lit_or_null,
                               one_row, rounded)

SUMMARY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("missing", T.LongType()), T.StructField("min", T.DoubleType()),
    T.StructField("median", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType()),
    T.StructField("variance", T.DoubleType()), T.StructField("unique_values", T.LongType()),
])


# P2 ---------------------------------------------------------------------------------
def classify(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """(numeric columns, categorical columns).  Everything not numeric is categorical."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        (num if is_numeric(df, f.name) and not is_factor(df, f.name) else cat).append(f.name)
    return num, cat


def is_text_like(df: DataFrame, name: str) -> bool:
    """string or factor (the file-details notion of categorical)."""
    return is_string(df, name) or is_factor(df, name)


# P1 ---------------------------------------------------------------------------------
def file_details(df: DataFrame, path: str) -> DataFrame:
    """File name, format, rows, columns, categorical (string/factor) and numerical counts."""
    name = os.path.basename(path.rstrip("/"))
    name, ext = os.path.splitext(name)
    ext = ext.lstrip(".").lower()
    n_cols = len(df.columns)
    n_cat = sum(1 for c in df.columns if is_text_like(df, c))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("file_name"), F.lit(ext).alias("file_format"), F.col("n_rows"),
        F.lit(n_cols).cast("long").alias("n_columns"), F.lit(n_cat).cast("long").alias("n_categorical"),
        F.lit(n_cols - n_cat).cast("long").alias("n_numerical"))


# P3 ---------------------------------------------------------------------------------
def qualitative(df: DataFrame, cols=None, max_distinct: int = QUALITATIVE_MAX_DISTINCT) -> DataFrame:
    """Per column: distinct values counting NULL as one, and the "qualitative" flag.

    Qualitative = string/factor, or numeric with at most ``max_distinct`` distinct
    values (NULL counted).  One aggregate pass over all columns.
    """
    cols = list(cols or df.columns)
    counts = distinct_counts(df, cols)
    out = []
    for c in cols:
        n = counts[c]
        qual = is_string(df, c) or is_factor(df, c) or (is_numeric(df, c) and n <= max_distinct)
        out.append((c, n, bool(qual)))
    schema = "column string, n_distinct long, qualitative boolean"
    return df.sparkSession.createDataFrame(out, schema)


def is_qualitative(df: DataFrame, c: str, max_distinct: int = QUALITATIVE_MAX_DISTINCT) -> bool:
    if is_string(df, c) or is_factor(df, c):
        return True
    if not is_numeric(df, c):
        return False
    return not exceeds_distinct(df, [c], max_distinct)[c]


def qualitative_flags(df: DataFrame, cols=None, max_distinct: int = QUALITATIVE_MAX_DISTINCT) -> DataFrame:
    """(column, qualitative) as ``qualitative`` gives them, without counting the distinct values of wide columns."""
    cols = list(cols or df.columns)
    nums = [c for c in cols if is_numeric(df, c) and not is_factor(df, c)]
    wide = exceeds_distinct(df, nums, max_distinct)
    rows = [(c, is_text_like(df, c) or (c in wide and not wide[c])) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, qualitative boolean")


# P4 ---------------------------------------------------------------------------------
def summary(df: DataFrame, cols=None, formatted: bool = False, digits: int | None = None) -> DataFrame:
    """One row per column: class, missing, min, median, max, mean, sd, variance, unique values.

    Numeric columns get the numeric statistics (sd and variance with n-1); other
    columns get the distinct count with NULL counted as a value.  With
    ``formatted=True`` every cell is text, "-" where not applicable, mean/sd/
    variance with three decimals, as the reference displays it.
    """
    cols = list(cols or df.columns)
    nums = [c for c in cols if is_numeric(df, c) and not is_factor(df, c)]
    exprs = []
    for c in cols:
        x = col(c)
        exprs.append(F.count_if(x.isNull()).alias(f"{c}||missing"))
        if c in nums:
            d = x.cast("double")
            exprs += [F.min(d).alias(f"{c}||min"), F.max(d).alias(f"{c}||max"), F.avg(d).alias(f"{c}||mean"),
                      F.stddev_samp(d).alias(f"{c}||sd"), F.var_samp(d).alias(f"{c}||variance")]
    row = one_row(df, exprs) if exprs else {}
    # distinct counts separately: a distinct aggregate in the same agg would make Spark
    # expand every row once per distinct column for all the other statistics too
    uniques = distinct_counts(df, [c for c in cols if c not in nums])
    medians = {c: v[0] for c, v in multi_quantiles(df, nums, [0.5]).items()}
    out = []
    for c in cols:
        if c in nums:
            med = medians[c]
            vals = [row[f"{c}||min"], med, row[f"{c}||max"], row[f"{c}||mean"], row[f"{c}||sd"], row[f"{c}||variance"]]
            out.append((c, "Numerical", int(row[f"{c}||missing"]), *vals, None))
        else:
            out.append((c, "Categorical", int(row[f"{c}||missing"]), None, None, None, None, None, None,
                        uniques[c]))
    res = df.sparkSession.createDataFrame(out, SUMMARY_SCHEMA)
    if digits is not None:
        res = res.select(*[rounded(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                           else F.col(f.name) for f in SUMMARY_SCHEMA.fields])
    return _format_summary(res) if formatted else res


def _num_text(c, three: bool = False):
    """Number as the reference displays it; "-" when not applicable (format_string prints NULL as "null")."""
    if three:
        txt = F.format_string(f"%.{SUMMARY_DECIMALS}f", c)
    else:
        # R turns numbers to text with up to 15 significant digits and drops trailing zeros.
        txt = F.regexp_replace(F.regexp_replace(F.format_string("%.15g", c), r"(\.\d*?)0+(e|$)", "$1$2"),
                               r"\.(e|$)", "$1")
    return F.when(c.isNull(), F.lit("-")).otherwise(txt)


def _format_summary(res: DataFrame) -> DataFrame:
    return res.select(
        F.col("column").alias("Column"), F.col("class").alias("Class"), F.col("missing").cast("string").alias("Missing"),
        _num_text(F.col("min")).alias("Min"), _num_text(F.col("median")).alias("Median"),
        _num_text(F.col("max")).alias("Max"), _num_text(F.col("mean"), True).alias("Mean"),
        _num_text(F.col("sd"), True).alias("SD"), _num_text(F.col("variance"), True).alias("Variance"),
        F.coalesce(F.col("unique_values").cast("string"), F.lit("-")).alias("Unique_Values"))


# P5 ---------------------------------------------------------------------------------
def missing_percent(df: DataFrame, c: str, digits: int = 2) -> DataFrame:
    return df.agg(F.round(F.lit(100.0) * F.avg(col(c).isNull().cast("double")), digits).alias("missing_percent"))


# P6 ---------------------------------------------------------------------------------
def describe_one(df: DataFrame, c: str, digits: int | None = None) -> DataFrame:
    """R-style ``summary()`` of one column.

    numeric: min, q1, median, mean, q3, max, na_count (+ sd, which the UI promises);
    factor / string: count per level (NULL as its own level, like R's NA's row).
    """
    if is_numeric(df, c) and not is_factor(df, c):
        q1, med, q3 = quantiles(df, c, [0.25, 0.5, 0.75]).first()
        d = col(c).cast("double")
        base = df.agg(F.min(d).alias("min"), F.avg(d).alias("mean"), F.max(d).alias("max"),
                      F.count_if(d.isNull()).alias("na_count"), F.stddev_samp(d).alias("sd"))
        both = base.select("*", lit_or_null(q1).alias("q1"), lit_or_null(med).alias("median"), lit_or_null(q3).alias("q3"))
        return both.select(*[rounded(F.col(n), digits).alias(n) for n in ("min", "q1", "median", "mean", "q3", "max")],
                           F.col("na_count"), rounded(F.col("sd"), digits).alias("sd"))
    return df.groupBy(col(c).alias("level")).agg(F.count("*").alias("count"))


# P7 ---------------------------------------------------------------------------------
def target_summary(df: DataFrame, c: str, digits: int | None = TARGET_DECIMALS) -> DataFrame:
    """Mean, Median, Min, Max, Range, Variance, SD, N (non-missing) as (metric, value) rows."""
    d = col(c).cast("double")
    med = quantiles(df, c, [0.5], names=["median"]).first()[0]
    row = one_row(df, [F.avg(d).alias("Mean"), F.min(d).alias("Min"), F.max(d).alias("Max"),
                       F.var_samp(d).alias("Variance"), F.stddev_samp(d).alias("SD"), F.count(d).alias("N")])
    rng = None if row["Max"] is None else row["Max"] - row["Min"]
    vals = [("Mean", row["Mean"]), ("Median", med), ("Min", row["Min"]), ("Max", row["Max"]), ("Range", rng),
            ("Variance", row["Variance"]), ("SD", row["SD"]), ("N", float(row["N"]))]
    res = df.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in vals],
                                          "metric string, value double")
    return res.select("metric", rounded(F.col("value"), digits).alias("value"))


# P8 ---------------------------------------------------------------------------------
def target_distribution(df: DataFrame, c: str) -> DataFrame:
    """Counts per level of a categorical target (NULL excluded, like R's table())."""
    return df.where(col(c).isNotNull()).groupBy(col(c).alias("level")).agg(F.count("*").alias("count"))


# P9 ---------------------------------------------------------------------------------
def audit(ws) -> DataFrame:
    """Pre-submission flags: categorical working columns left, one-hot applied, any missing value."""
    work = ws.working()
    has_cat = any(not is_numeric(work, c) or is_factor(work, c) for c in ws.work)
    one_hot = len(ws.work) != len(ws.raw)
    cols = [col(ws.wcol(c)).isNull() for c in ws.work]
    any_null = F.lit(False)
    for e in cols:
        any_null = any_null | e
    return ws.df.agg(F.coalesce(F.bool_or(any_null), F.lit(False)).alias("has_missing")).select(
        F.lit(has_cat).alias("has_categorical"), F.lit(one_hot).alias("one_hot_applied"), "has_missing")


# S6 ---------------------------------------------------------------------------------
def browse(df: DataFrame, search: str | None = None, order_by=None, descending: bool = False,
           page: int = 1, page_size: int = PAGE_SIZE, key: str | None = None, direct_rows: int | None = None) -> DataFrame:
    """Search (case-insensitive substring over all cells), sort, page.

    Paging is the feature here.  The sort is a top-k (TakeOrderedAndProject) while the page ends within ``direct_rows``
    rows (``BROADCAST_ROWS`` unless given), so only so many rows meet in one task.  A deeper page of a sorted table is
    found by range partitions: their row counts tell which hold the page, and only those are sorted.  Both ways give the
    same page where ``key`` or ``order_by`` is unique.
    """
    out = df
    if search:
        text = F.lower(F.concat_ws(" ", *[col(c).cast("string") for c in df.columns]))
        out = out.where(text.contains(search.lower()))
    orders = []
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    for c in names:
        orders.append(col(c).desc() if descending else col(c).asc())
    if key and key not in names:
        orders.append(col(key).asc())
    start = (page - 1) * page_size
    if orders and start + page_size > (S.BROADCAST_ROWS if direct_rows is None else direct_rows):
        return _deep_page(out, orders, start, page_size)
    if orders:
        out = out.orderBy(*orders)
    return out.limit(start + page_size).offset(start) if start else out.limit(page_size)


def _deep_page(df: DataFrame, orders: list, start: int, page_size: int, rows_per_part: int = 100_000) -> DataFrame:
    """Rows start .. start + page_size - 1 of the sorted table; ties are ordered by the rows' hash, so none fills a part alone."""
    names = df.columns
    total = df.count()
    if start >= total:
        return df.limit(0)
    tie = F.xxhash64(*[col(c) if not isinstance(df.schema[c].dataType, T.MapType) else F.map_entries(col(c)) for c in names])
    ranged = S.cut_lineage(df.withColumn("__tie", tie)
                           .repartitionByRange(max(8, min(10_000, total // rows_per_part + 1)), *orders, F.col("__tie").asc())
                           .withColumn("__pid", F.spark_partition_id()))
    # one row per range partition
    wanted, before, seen = [], None, 0
    for r in sorted(ranged.groupBy("__pid").count().collect(), key=lambda r: r["__pid"]):
        if seen + r["count"] > start and seen < start + page_size:
            wanted.append(r["__pid"])
            before = seen if before is None else before
        seen += r["count"]
    rows = ranged.where(F.col("__pid").isin(wanted)).orderBy(*orders, F.col("__tie").asc())
    skip = start - before
    return rows.limit(skip + page_size).offset(skip).select(*[col(c) for c in names])
