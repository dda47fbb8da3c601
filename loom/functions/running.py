"""Running sums in a global order without a one-task window.

A window ``ORDER BY s`` with no PARTITION BY moves every row to one task.
For small inputs (at most ``BROADCAST_ROWS`` rows, checked) that is what we
use.  Otherwise the rows are range-partitioned on (group, order), summed per
partition, the per-partition totals (a table with one row per partition and
group) are turned into offsets, and the running sum is finished inside each
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session as S
from .stats import col


def running_sums(df: DataFrame, order_col: str, sum_cols, by: str | None = None, prefix: str = "cum_",
                 partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sum_cols`` ordered by ``order_col`` (ascending).

    ``order_col`` must be unique within ``by`` (e.g. a table already grouped by it).
    """
    sum_cols = list(sum_cols)
    n = df.count()
    part = [col(by)] if by else []
    if n <= S.BROADCAST_ROWS:
        w = Window.partitionBy(*part).orderBy(col(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(col(c)).over(w).alias(prefix + c) for c in sum_cols])
    nparts = partitions or max(8, min(10_000, n // 1_000_000 + 1))
    ranged = df.repartitionByRange(nparts, *part, col(order_col)).withColumn("__pid", F.spark_partition_id())
    ranged = S.cut_lineage(ranged)  # the offsets below refer to this exact partition layout
    grp = [col(by).alias("__g")] if by else []
    totals = ranged.groupBy("__pid", *grp).agg(*[F.sum(col(c)).alias("__t_" + c) for c in sum_cols])
    wt = Window.partitionBy(*([F.col("__g")] if by else [])).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__pid").alias("__opid"), *([F.col("__g").alias("__og")] if by else []),
                            *[F.coalesce(F.sum("__t_" + c).over(wt), F.lit(0)).alias("__o_" + c) for c in sum_cols])
    cond = F.col("__pid") == F.col("__opid")
    if by:
        cond = cond & col(by).eqNullSafe(F.col("__og"))
    right = F.broadcast(offsets) if totals.count() <= S.BROADCAST_ROWS else offsets  # partitions x groups rows
    joined = ranged.join(right, cond)
    w = (Window.partitionBy(F.col("__pid"), *part).orderBy(col(order_col))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined.select(*[col(c) for c in df.columns],
                        *[(F.sum(col(c)).over(w) + F.col("__o_" + c)).alias(prefix + c) for c in sum_cols])
    return out
