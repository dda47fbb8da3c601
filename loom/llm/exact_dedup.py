"""Exact dedup by content sort [native].

The normalised bytes (white space deleted) are range-partitioned by sampled splitters on their leading bytes, then a
digest; an external sort inside each range places equal texts next to each other, and a window keyed by the full
normalised text compares neighbours in full and finds the row that stays.  Only the leading bytes and a digest serve
as splitter keys, so what the sampling sends to the driver is bounded whatever the text length.

Skew: a text whose copies exceed a fair share of a range (rows / (8 x ranges)) is dealt over several salted sub-ranges;
there are at most 8 x ranges such texts, so their list is broadcast.  Their part results (one head per sub-range, full
text included) are merged by a second, full comparison.

Defined results: NULL text = empty text; all empty or blank texts are equal; ties in length go to the smallest id
(NULL id last); of fully repeated rows one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, kept_rows, shuffle_width, staged, text_of

LEAD = 16


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    ranges = shuffle_width(spark)
    text = text_of(text_col)
    base = (docs.select(F.col(id_col).alias("doc_id"), normalised(text).alias("norm"),
                        F.char_length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("text_key"))
            .withColumn("digest", F.xxhash64("norm")))
    share = max(64, docs.count() // (8 * ranges))
    hot = (base.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > share)
           .select("digest", F.ceil(F.col("copies") / F.lit(share)).alias("parts")))
    dealt = (base.join(F.broadcast(hot), "digest", "left")
             .withColumn("lead", F.substring("norm", 1, LEAD))
             .withColumn("salt", F.when(F.col("parts").isNull(), F.lit(0))
                         .otherwise(1 + F.pmod(F.xxhash64("doc_id", "n_chars"), F.col("parts"))).cast("long"))
             .drop("parts")
             .repartitionByRange("lead", "digest", "salt"))
    runs = Window.partitionBy("lead", "digest", "salt", "norm")
    ordered = runs.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    placed = (dealt.withColumn("place", F.row_number().over(ordered))
              .withColumn("part_keep", F.first("doc_id").over(ordered))
              .withColumn("part_chars", F.first("n_chars").over(ordered))
              .withColumn("part_size", F.count(F.lit(1)).over(runs))
              .select("doc_id", "text_key", "digest", "salt", "place", "part_keep", "part_chars", "part_size",
                      F.sha2("norm", 256).alias("text_sha256"),
                      F.when((F.col("salt") > 0) & (F.col("place") == 1), F.col("norm")).alias("head")))
    placed = staged(placed, "exact-dedup")
    heads = placed.filter(F.col("head").isNotNull())
    best = F.min_by(F.struct("part_keep", "salt"),
                    F.struct(-F.col("part_chars"), F.col("part_keep").isNull(), F.col("part_keep")))
    merged = (heads.groupBy("digest", "text_sha256", "head")
              .agg(best.alias("best"), F.sum("part_size").alias("size"))
              .select("digest", "text_sha256", F.col("best.part_keep").alias("all_keep"),
                      F.col("best.salt").alias("all_salt"), "size"))
    out = placed.join(F.broadcast(merged), ["digest", "text_sha256"], "left")
    split = F.col("salt") > 0
    return out.select(
        "doc_id", "text_key",
        F.when(split, F.col("all_keep")).otherwise(F.col("part_keep")).alias("keep_id"),
        F.when(split, F.col("size")).otherwise(F.col("part_size")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("salt") == F.col("all_salt")))).alias("kept"),
        "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay; of rows that share id and text one stays."""
    return kept_rows(docs, exact_dedup(docs, id_col, text_col).filter("kept"), id_col, text_col)
