"""Shared pieces of the text operators: column normalisation, staged tables, Arrow batch bounds.

Conventions that hold for every operator of this subpackage
* a NULL text counts as the empty text; a NULL id is kept and sorts last;
* words are the runs ``[^\\x20\\x09-\\x0D]+``;
* rows that share id *and* text are repeated rows: each of them appears in the result;
* only the id, text (and source) columns named by the caller are used; other columns,
  whatever their names, neither clash nor influence a result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loom.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 1000      # rows of an Arrow batch: bounds a Python worker's memory for long texts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(text_col: str) -> Column:
    """The whole text; NULL is the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared checkpoint folder and return the written table.

    Used where an intermediate is read more than once: it cuts the lineage, survives lost executors, and later
    steps see the same rows.  Each call takes a new folder; the folders live as long as the cluster keeps
    ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loom-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def kept_rows(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str, unique: bool = True) -> DataFrame:
    """Rows of docs whose (doc_id, text_key) is in verdict; with ``unique``, one row for each such pair."""
    names = docs.columns
    marked = docs.withColumns({"_loom_key": F.xxhash64(text_of(text_col)), "_loom_id": F.col(id_col)})
    wanted = verdict.select(F.col("doc_id").alias("_loom_id2"), F.col("text_key").alias("_loom_key2"))
    rows = marked.join(wanted, (F.col("_loom_id").eqNullSafe(F.col("_loom_id2")))
                       & (F.col("_loom_key") == F.col("_loom_key2")), "left_semi")
    if unique:
        rows = rows.dropDuplicates(["_loom_id", "_loom_key"])
    return rows.select(*[F.col(f"`{c}`") for c in names])
