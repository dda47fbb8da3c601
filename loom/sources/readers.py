"""Loading tables (S1-S3).

Missing-value rules are normalised at load so every operator can assume NULL
is the only missing value:

* floating columns: NaN -> NULL (``nanvl(x, NULL)``);
* CSV: the text ``NA`` is missing; a blank in a *string* column is either
  missing (``blank_strings="null"``, default) or the empty-string category
  (``blank_strings="category"``, what the reference's CSV reader does).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import FLOAT_TYPES, col

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


def file_format(path: str) -> str:
    """File format from the extension; unknown extension -> ValueError (nothing loaded)."""
    base = path.rstrip("/")
    ext = os.path.splitext(base)[1].lower()
    if ext in FORMATS:
        return FORMATS[ext]
    if ext in (".xlsx", ".xls"):
        raise ValueError("Excel workbooks are not readable by Spark here; export the 'Data' sheet to CSV")
    raise ValueError(f"unsupported file type {ext!r}; use .csv or .parquet")


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (R's is.na is true for NaN)."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def _strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        return df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def read_csv(spark: SparkSession, path: str, blank_strings: str = "null", multiline: bool = False,
             ragged: str = "fail") -> DataFrame:
    """Doubled quotes inside quoted cells are read as one; ``multiline`` allows line breaks there (files are then not split).
    Dates and times stay text.

    A row with more cells than the header is an error (its cells would be lost), as is one with fewer: reading it
    stops with Spark's message, which names the row.  ``ragged="fill"`` pads short rows with NULL and drops extra cells.
    """
    if ragged not in ("fail", "fill"):
        raise ValueError("ragged must be 'fail' or 'fill'")
    if blank_strings not in ("null", "category"):
        raise ValueError("blank_strings must be 'null' or 'category'")
    quoting = dict(header=True, quote='"', escape='"', multiLine=multiline)
    # without pruning every cell of a row is counted, whichever columns a query reads
    quoting.update(mode="FAILFAST" if ragged == "fail" else "PERMISSIVE", columnPruning=ragged != "fail")
    opts = dict(nullValue="NA", **quoting)
    found = spark.read.options(inferSchema=True, **opts).csv(path).schema
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(
        f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else f.dataType) for f in found.fields])
    typed = _strip_bom(spark.read.options(**opts).schema(plain).csv(path))
    if blank_strings == "null":
        # A quoted "" stays an empty string in Spark: make it missing too.
        return typed.select(*[
            (F.nullif(col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name)
            for f in typed.schema.fields
        ])
    # Blank strings as a category: read as text without nullValue (NA stays text,
    # blank is NULL), then map blank -> '' and 'NA' -> NULL and cast the rest.
    text = _strip_bom(spark.read.options(inferSchema=False, **quoting).csv(path))
    cols = []
    for f, tcol in zip(typed.schema.fields, text.columns):
        c = col(tcol)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isNull(), F.lit("")).when(c == "NA", F.lit(None).cast("string")).otherwise(c)
        else:
            c = F.when(c == "NA", F.lit(None)).otherwise(c).try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return text.select(*cols)


def in_ranges(df: DataFrame, ranges: dict) -> DataFrame:
    """Rows whose columns lie in their closed ranges: column -> (lowest, highest), None for an open end.

    Missing values (NULL, NaN) are in no range.  The comparisons are on the stored columns, so they reach a Parquet scan.
    """
    unknown = [c for c in ranges if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    for c, (low, high) in ranges.items():
        known = col(c).isNotNull()
        if isinstance(df.schema[c].dataType, FLOAT_TYPES):
            known = known & ~F.isnan(col(c))     # NaN sorts above all numbers: an open upper end would keep it
        df = df.where(known)
        if low is not None:
            df = df.where(col(c) >= F.lit(low))
        if high is not None:
            df = df.where(col(c) <= F.lit(high))
    return df


def load(spark: SparkSession, path: str, blank_strings: str = "null", sanitize_names: bool = False,
         multiline: bool = False, ragged: str = "fail", ranges: dict | None = None) -> DataFrame:
    """Load a CSV or Parquet file (format from the extension) with missing values normalised.

    ``blank_strings``, ``multiline`` and ``ragged`` are those of ``read_csv``.  ``ranges`` (column -> (lowest, highest),
    names as stored) loads only the rows inside; on Parquet, float columns included, the scan skips what lies outside.
    """
    fmt = file_format(path)
    if fmt == "csv":
        df = read_csv(spark, path, blank_strings, multiline, ragged)
    else:
        df = spark.read.parquet(path)
    # CSV ranges hold for the normalised cells; malformed rows outside the ranges may go unseen there
    df = normalise_missing(in_ranges(df, ranges or {})) if fmt != "csv" else in_ranges(normalise_missing(df), ranges or {})
    if sanitize_names:
        df = df.toDF(*[_sanitize(c) for c in df.columns])
    return df


def _sanitize(name: str) -> str:
    out = "".join(ch if ch.isalnum() or ch == "_" else "." for ch in name)
    return out if not out[:1].isdigit() else "X" + out


def add_row_key(df: DataFrame, key: str = "row_id", chunk: int = 1_000_000, fields: list[str] | None = None) -> DataFrame:
    """Stable row key for a keyless table.

    Key = md5 of the row's JSON (of ``fields``, where the other columns are functions of these) plus an occurrence number among identical rows.
    Identical rows are interchangeable, so they are collapsed to (row, count)
    (partial aggregation keeps a hot duplicate group cheap) and re-expanded in
    chunks of ``chunk`` rows, so no single task emits a huge duplicate group.
    The result does not depend on partitioning.
    """
    columns, fields = df.columns, list(fields or df.columns)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    h = F.md5(F.to_json(F.struct(*[col(c) for c in fields]), exact))
    grouped = df.groupBy(*[col(c) for c in columns]).agg(F.count("*").alias("__cnt")).withColumn("__h", h)
    chunks = grouped.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__cnt") - 1) / chunk))))
    chunks = chunks.repartition(col("__h"), col("__chunk"))
    lo = F.col("__chunk") * chunk + 1
    hi = F.least(F.col("__cnt"), (F.col("__chunk") + 1) * chunk)
    rows = chunks.withColumn("__i", F.explode(F.sequence(lo, hi)))
    return rows.select(F.concat(F.col("__h"), F.lit(":"), F.col("__i").cast("string")).alias(key),
                       *[col(c) for c in columns])

