"""Line dedup by overlapping three-line windows.

Lines are split at line feeds.  Every three consecutive lines of a document are hashed; windows whose hash occurs more
than once anywhere are kept as candidates, and every occurrence but the first (smallest id, then smallest line) is
removed by merging the lines it covers.  Windows are judged on the input, not on what is left.

The global search shuffles hashes only, pre-aggregated on the map side; occurrences of repeated windows are found by
a join that adaptive execution can split on a hot hash.  Texts move once, and only to meet their removed lines.

Defined results: NULL text = empty text = one empty line; documents of fewer than three lines lose nothing; rows that
share an id are ordered by line only, so neither is "earlier" for the same line number; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_text."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")) \
        .withColumn("text_key", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    hashed = (base.select("doc_id", "text_key", lines.alias("lines"))
              .filter(F.size("lines") >= window)
              .select("doc_id", "text_key",
                      F.transform(F.sequence(F.lit(0), F.size("lines") - window),
                                  lambda i: F.xxhash64(*[F.get("lines", i + k) for k in range(window)],
                                                       F.lit(window))).alias("keys")))
    windows = staged(hashed, "line-windows").select("doc_id", "text_key", F.posexplode("keys").alias("at", "key"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("at").alias("at"))
    repeated = (windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                .filter("n > 1").select("key", "first"))
    later = windows.join(repeated, "key").filter(place > F.col("first"))
    covered = (later.select("doc_id", "text_key", "at").distinct()
               .groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("starts")))
    lost = F.array_distinct(F.flatten(F.transform(
        "starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: s + k))))
    # NULL-safe on the id; the text key keeps rows apart that share an id
    joined = base.alias("b").join(
        covered.alias("c"),
        F.col("b.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("b.text_key") == F.col("c.text_key")), "left")
    cut = joined.select(F.col("b.doc_id").alias("doc_id"), F.col("b.text").alias("text"), lines.alias("lines"),
                        F.when(F.col("starts").isNotNull(), lost).alias("lost"))
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    return cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("lost").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n")).alias("kept_text"))
