"""Counts of pairs of categories, for any number of levels.

The observed pairs are one sparse aggregate (x, y, n); totals per level are
aggregates of it, joined back.  A dense table (zero cells included) is made by
an equi-join with the numbered levels of one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session as S
from .rank import value_dictionary
from .stats import col


def pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) of the observed pairs; rows with a NULL on either side don't count."""
    return (df.where(col(x).isNotNull() & col(y).isNotNull())
            .groupBy(col(x).alias("x"), col(y).alias("y")).agg(F.count("*").alias("n")))


def level_totals(cells: DataFrame, side: str) -> DataFrame:
    """(side, total) of a sparse table."""
    return cells.groupBy(side).agg(F.sum("n").alias(f"{side}_total"))


def dense_cells(cells: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """(x, y, n) for every level of xs (column x) with every level of ys (column y); n is 0 where not observed."""
    numbered, count = value_dictionary(ys, "y", code_col="__code")
    numbers = F.sequence(F.lit(1).cast("long"), F.lit(max(count, 1)).cast("long"))
    every = xs.select("x", F.explode(numbers).alias("__code"))
    right = F.broadcast(numbered) if count <= S.BROADCAST_ROWS else numbered
    grid = every.join(right, "__code").select("x", "y")
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chi_square_share(cells: DataFrame) -> DataFrame:
    """One row: phi2 = chi-square / N of a sparse table, and the number of levels of each side (n_x, n_y).

    chi2 / N = sum(n^2 / (row total * column total)) - 1, to which unobserved pairs add nothing.
    """
    rows, cols = level_totals(cells, "x"), level_totals(cells, "y")
    none = F.lit(None)
    phi2 = F.sum(F.col("n") / F.col("x_total") * (F.col("n") / F.col("y_total"))) - 1
    share = (cells.join(rows, "x").join(cols, "y").agg(phi2.alias("phi2"))
             .select(F.when(F.col("phi2") < 0, F.lit(0.0)).otherwise(F.col("phi2")).alias("phi2")))   # rounding
    parts = [share.select("phi2", none.cast("long").alias("n_x"), none.cast("long").alias("n_y")),
             rows.agg(F.count("*").alias("n_x")).select(none.cast("double").alias("phi2"), "n_x", none.cast("long").alias("n_y")),
             cols.agg(F.count("*").alias("n_y")).select(none.cast("double").alias("phi2"), none.cast("long").alias("n_x"), "n_y")]
    return parts[0].union(parts[1]).union(parts[2]).agg(*[F.max(c).alias(c) for c in ("phi2", "n_x", "n_y")])
