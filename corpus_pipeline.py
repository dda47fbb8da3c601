"""Corpus pipeline: toxicity filter, exact dedup, near dedup, benchmark decontamination, mixing to target weights.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loom.llm.common import documents, staged
from loom.llm.decontamination import decontaminate
from loom.llm.exact_dedup import drop_copies
from loom.llm.mixing import mix
from loom.llm.near_dedup import drop_near_copies
from loom.llm.queries import TOXIC_AT, toxic_training_rows
from loom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores as toxic go."""
    return reject_toxic(docs, toxic_training_rows(spark, docs, sf_dir), TOXIC_AT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more of five-word shingles) the smallest id stays."""
    return drop_near_copies(docs, percent=80, shingle=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template with consistent slots go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed to the sources' target weights."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark),
          ("mixing", mixing)]

ORACLE_SQL = None      # scores, registers and permutations have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
