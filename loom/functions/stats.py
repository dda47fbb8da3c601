"""Shared statistics helpers.

Design rules used by every operator:

* all per-column statistics of one step are computed in ONE ``agg`` (one pass,
  partial + final aggregation), never one job per column;
* a statistic that parameterises a row-level step (mean, bounds, ...) is a
  one-row aggregate whose values are inlined as literals; the row-level step is
  then a narrow projection/filter that Catalyst can fold and push into the scan;
* every division that may see a zero denominator goes through ``try_divide``
  (Spark 4 runs with ANSI on; R gives NaN where Spark would raise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """Column by exact name (names may hold spaces, dots or quotes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), NUMERIC_TYPES)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def is_factor(df: DataFrame, name: str) -> bool:
    return (df.schema[name].metadata or {}).get("role") == "factor"



def one_row(df: DataFrame, exprs: Sequence[Column]) -> dict:
    """Run one global aggregate (always exactly one row) and return it as a dict."""
    row = df.agg(*exprs).first()
    return row.asDict() if row is not None else {}


def lit_or_null(value, type_name: str = "double") -> Column:
    return F.lit(None).cast(type_name) if value is None else F.lit(value).cast(type_name)



def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs; NULL (not an ANSI error) when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def spark_interpolate(values_lo: float, values_hi: float, pos: float) -> float:
    """Type-7 interpolation written the way Spark's ``percentile`` evaluates it."""
    lower = int(pos // 1)
    higher = -int(-pos // 1)
    if higher == lower:
        return float(values_lo)
    return (higher - pos) * values_lo + (pos - lower) * values_hi



def complete_rows(df: DataFrame, cols=None) -> DataFrame:
    """Rows with no missing value in ``cols`` (all columns by default); NaN counts as missing.

    Written as a conjunction of per-column predicates rather than ``dropna``:
    ``dropna`` becomes one predicate over every column, and Catalyst's
    constraint propagation copies such a predicate once per aliased column of
    every later projection (exponential in wide plans); per-column predicates
    grow linearly and are pushed into the Parquet scan one by one.
    """
    cols = list(df.columns if cols is None else cols)
    cond = F.lit(True)
    for c in cols:
        x = col(c)
        p = x.isNotNull()
        if isinstance(df.schema[c].dataType, FLOAT_TYPES):
            p = p & ~F.isnan(x)
        cond = cond & p
    return df.where(cond)


INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def stacked_values(df: DataFrame, cols) -> DataFrame:
    """(g, l, d, s): per row and column its number and the value in a typed slot (integral, floating, text)."""
    structs = []
    for i, c in enumerate(cols):
        t = df.schema[c].dataType
        li = col(c).cast("long") if isinstance(t, INTEGRAL_TYPES) else F.lit(None).cast("long")
        db = col(c).cast("double") if isinstance(t, FLOAT_TYPES) else F.lit(None).cast("double")
        # decimals go as text: a column has one scale, and double would merge values beyond 2^53
        tx = col(c).cast("string") if not isinstance(t, INTEGRAL_TYPES + FLOAT_TYPES) else F.lit(None).cast("string")
        structs.append(F.struct(F.lit(i).alias("g"), li.alias("l"), db.alias("d"), tx.alias("s")))
    return df.select(F.explode(F.array(*structs)).alias("v")).select("v.*")


def distinct_counts(df: DataFrame, cols) -> dict:
    """Exact distinct values per column, NULL counted as one value (R's ``length(unique(x))``).

    All columns in one job: each row is stacked into (column, value) pairs held in
    a typed slot (integral, floating, others and decimals as text), distinct pairs are found with
    partial aggregation, then counted per column.
    """
    cols = list(cols)
    if not cols:
        return {}
    pairs = stacked_values(df, cols).distinct()
    rows = pairs.groupBy("g").count().collect()  # one row per column
    got = {r["g"]: r["count"] for r in rows}
    return {c: int(got.get(i, 0)) for i, c in enumerate(cols)}


_WORDS = 4     # 64-bit words of a column's bitmap


def exceeds_distinct(df: DataFrame, cols, limit: int) -> dict:
    """Per column: does it hold more than ``limit`` distinct values (NULL counted as one)?  Nothing is shuffled by value.

    One aggregate sets a bit per hashed value in a 256-bit map of each column; the bits set are never more than the
    distinct values, so a count above ``limit`` proves the answer.  Only columns that stay at or below it, which hold
    few values, are counted exactly.
    """
    cols = list(cols)
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = col(c)
        if isinstance(df.schema[c].dataType, FLOAT_TYPES):
            x = x + F.lit(0.0)                        # -0.0 and 0.0 are one value
        h = F.pmod(F.xxhash64(x), F.lit(64 * _WORDS))
        bit = F.lit(1).cast("long")
        for w in range(_WORDS):
            here = x.isNotNull() & (F.floor(h / 64) == w)
            aggs.append(F.bit_or(F.when(here, F.call_function("shiftleft", bit, (h % 64).cast("int")))).alias(f"{i}_{w}"))
        aggs.append(F.max(x.isNull().cast("int")).alias(f"{i}_null"))
    row = one_row(df, aggs)
    least = {c: sum(bin((row[f"{i}_{w}"] or 0) & (2 ** 64 - 1)).count("1") for w in range(_WORDS)) + (row[f"{i}_null"] or 0)
             for i, c in enumerate(cols)}
    few = distinct_counts(df, [c for c in cols if least[c] <= limit])
    return {c: least[c] > limit or few[c] > limit for c in cols}
