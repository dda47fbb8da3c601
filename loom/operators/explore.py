"""Univariate (A1-A4) and bivariate (B1-B10) exploration.

Every chart of the reference becomes its plot data as a DataFrame.  Row-level
work is aggregation on the executors; what comes back to the driver is a
one-row statistic or, for tables with a column per level, a level list bounded
by ``MAX_LEVELS``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session as S
from ..functions.moments import correlations
from ..functions.pairs import chi_square_share, dense_cells, level_totals, pair_counts
from ..functions.quantile import quantile_values, quantiles
from ..functions.stats import col, complete_rows, guarded_corr, is_factor, is_numeric, is_string, one_row, rounded
from ..fixed import HIST_BINS, IQR_FACTOR, QUALITATIVE_MAX_DISTINCT, STAT_DECIMALS
from .profile import is_qualitative


def _require_numeric(df: DataFrame, c: str) -> None:
    if not is_numeric(df, c) or is_factor(df, c):
        raise ValueError(f"{c!r} must be numeric")


def _categorical(df: DataFrame, c: str) -> bool:
    return is_string(df, c) or is_factor(df, c)


# A1 -----------------------------------------------------------------------------------
def histogram(df: DataFrame, c: str, bins: int = HIST_BINS, binwidth: float | None = None) -> DataFrame:
    """Equal-width bins from min to max (last bin closed); empty bins are kept.

    ``binwidth`` (the UI's bin-width control) overrides ``bins``.
    """
    _require_numeric(df, c)
    if binwidth is not None and binwidth <= 0:
        raise ValueError("binwidth must be positive")
    x = col(c).cast("double")
    s = one_row(df, [F.min(x).alias("lo"), F.max(x).alias("hi")])
    lo, hi = s["lo"], s["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin long, lower double, upper double, count long")
    if binwidth:
        nb = max(1, int(math.ceil((hi - lo) / binwidth)))
        w = float(binwidth)
    else:
        nb = int(bins)
        w = (hi - lo) / nb
    if w == 0:
        b = F.lit(0).cast("long")
    else:
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(nb - 1)).cast("long")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    grid = spark.range(nb).withColumnRenamed("id", "bin")
    # at most nb rows on both sides; a tiny bin width makes nb unbounded, then the join shuffles
    small = F.broadcast(counts) if nb <= S.BROADCAST_ROWS else counts.hint("merge")
    return (grid.join(small, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


# A2 -----------------------------------------------------------------------------------
def category_counts(df: DataFrame, c: str) -> DataFrame:
    """Bar data: count per level, NULL excluded, in level order."""
    return (df.where(col(c).isNotNull()).groupBy(col(c).alias("level")).agg(F.count("*").alias("count"))
            .orderBy("level"))


# A3 -----------------------------------------------------------------------------------
def box_stats(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """Box-plot statistics (type-7 quartiles, 1.5*IQR fences, whiskers, outlier count).

    With ``by`` (B6): one row per level of ``by``; NULL is its own level.
    """
    _require_numeric(df, c)
    if by is not None:
        return _box_by(df, c, by)
    x = col(c).cast("double")
    q1, med, q3 = quantile_values(df, c, [0.25, 0.5, 0.75])
    if q1 is None:
        schema = ("q1 double, median double, q3 double, lower_fence double, upper_fence double, "
                  "lower_whisker double, upper_whisker double, n_outliers long")
        return df.sparkSession.createDataFrame([(None,) * 7 + (0,)], schema)
    lf, uf = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
    return df.agg(
        F.min(F.when(x >= F.lit(lf), x)).alias("lower_whisker"),
        F.max(F.when(x <= F.lit(uf), x)).alias("upper_whisker"),
        F.count_if((x < F.lit(lf)) | (x > F.lit(uf))).alias("n_outliers"),
    ).select(F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
             F.lit(lf).alias("lower_fence"), F.lit(uf).alias("upper_fence"),
             "lower_whisker", "upper_whisker", "n_outliers")


def outlier_points(df: DataFrame, c: str) -> DataFrame:
    """The rows drawn as outlier points of the box plot."""
    q1, q3 = quantile_values(df, c, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    lf, uf = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
    x = col(c)
    return df.where((x < F.lit(lf)) | (x > F.lit(uf)))


def _box_by(df: DataFrame, c: str, by: str) -> DataFrame:
    qs = quantiles(df, c, [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"])
    fences = qs.select(col(by).alias("__lvl"), "q1", "median", "q3",
                       (F.col("q1") - IQR_FACTOR * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
                       (F.col("q3") + IQR_FACTOR * (F.col("q3") - F.col("q1"))).alias("upper_fence"))
    right = F.broadcast(fences) if fences.count() <= S.BROADCAST_ROWS else fences
    x = col(c).cast("double")
    joined = df.select(col(by).alias("__g"), x.alias("__x")).join(right, F.col("__g").eqNullSafe(F.col("__lvl")))
    lf, uf, xx = F.col("lower_fence"), F.col("upper_fence"), F.col("__x")
    return (joined.groupBy("__lvl", "q1", "median", "q3", "lower_fence", "upper_fence")
            .agg(F.min(F.when(xx >= lf, xx)).alias("lower_whisker"),
                 F.max(F.when(xx <= uf, xx)).alias("upper_whisker"),
                 F.count_if((xx < lf) | (xx > uf)).alias("n_outliers"))
            .withColumnRenamed("__lvl", "level"))


# A4 -----------------------------------------------------------------------------------
def category_shares(df: DataFrame, c: str, max_distinct: int = QUALITATIVE_MAX_DISTINCT) -> DataFrame:
    """Pie data: count and share per level (NULL excluded); needs a qualitative column (P3)."""
    if not is_qualitative(df, c, max_distinct):
        raise ValueError(f"{c!r} is not qualitative (string, factor or <= {max_distinct} distinct values)")
    total = one_row(df, [F.count(col(c)).alias("n")])["n"]
    counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("level")).agg(F.count("*").alias("count"))
    return counts.select("level", "count", F.try_divide(F.col("count").cast("double"), F.lit(float(total))).alias("share"))


# B1 -----------------------------------------------------------------------------------
def scatter(df: DataFrame, x: str, y: str, bins: int | None = None) -> DataFrame:
    """Scatter data: the complete (x, y) pairs, or with ``bins`` the 2-D bin counts.

    At scale the binned form is the one to draw: its size is bounded by bins^2.
    """
    pairs = complete_rows(df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")))
    if not bins:
        return pairs
    s = one_row(pairs, [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")])
    if s["x0"] is None:
        return df.sparkSession.createDataFrame([], "bx long, by long, x_lower double, y_lower double, count long")
    wx = (s["x1"] - s["x0"]) / bins
    wy = (s["y1"] - s["y0"]) / bins

    def b(c, lo, w):
        return F.lit(0).cast("long") if w == 0 else F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("long")

    return (pairs.groupBy(b("x", s["x0"], wx).alias("bx"), b("y", s["y0"], wy).alias("by"))
            .agg(F.count("*").alias("count"))
            .select("bx", "by", (F.lit(s["x0"]) + F.col("bx") * F.lit(wx)).alias("x_lower"),
                    (F.lit(s["y0"]) + F.col("by") * F.lit(wy)).alias("y_lower"), "count"))


# B2 -----------------------------------------------------------------------------------
def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y = intercept + slope * x over complete pairs (NULL slope if x is constant)."""
    _require_numeric(df, x)
    _require_numeric(df, y)
    both = col(x).isNotNull() & col(y).isNotNull()
    xx, yy = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    slope = F.try_divide(F.covar_pop(xx, yy), F.var_pop(xx))
    return (df.agg(slope.alias("slope"), F.avg(xx).alias("mx"), F.avg(yy).alias("my"), F.count(xx).alias("n"))
            .select("slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "n"))


# B3 -----------------------------------------------------------------------------------
def pearson(df: DataFrame, x: str, y: str, digits: int | None = STAT_DECIMALS) -> DataFrame:
    _require_numeric(df, x)
    _require_numeric(df, y)
    return df.agg(rounded(guarded_corr(col(x), col(y)), digits).alias("r"))


# B4 -----------------------------------------------------------------------------------
def corr_matrix(df: DataFrame, cols=None, digits: int | None = None) -> DataFrame:
    """Correlation matrix over listwise-complete rows, long form (x, y, r) for x <= y."""
    cols = list(cols or [f.name for f in df.schema.fields if is_numeric(df, f.name) and not is_factor(df, f.name)])
    if not cols:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    res = correlations(df, cols)
    return res.select("x", "y", rounded(F.col("r"), digits).alias("r"))


# B5 -----------------------------------------------------------------------------------
def correlation_ratio(df: DataFrame, x: str, y: str, digits: int | None = STAT_DECIMALS) -> DataFrame:
    """eta = sqrt(s2_E / s2_y), categorical x, numeric y.

    s2_E = sum_l n_l (mean_l - mean)^2 / N, where n_l and N count all rows
    (NULL y included), mean and s2_y (population variance) use non-NULL y;
    NULL-x rows count in N but in no group.  A group whose y is all NULL makes
    the result NULL (NaN in the reference).
    """
    _require_numeric(df, y)
    yy = col(y).cast("double")
    g = one_row(df, [F.count(F.lit(1)).alias("N"), F.avg(yy).alias("m"), F.var_pop(yy).alias("v")])
    if g["m"] is None:
        return df.sparkSession.createDataFrame([(None,)], "eta double")
    groups = df.where(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("n"), F.avg(yy).alias("ml"))
    s2e = F.sum(F.col("n") * (F.col("ml") - F.lit(g["m"])) ** 2) / F.lit(float(g["N"]))
    eta = F.when(F.bool_or(F.col("ml").isNull()), F.lit(None).cast("double")).otherwise(
        F.sqrt(F.try_divide(s2e, F.lit(g["v"]).cast("double"))))
    return groups.agg(rounded(eta, digits).alias("eta"))


# B7 / B8 ------------------------------------------------------------------------------
def contingency(df: DataFrame, x: str, y: str, wide: bool = False, check_qualitative: bool = True) -> DataFrame:
    """Counts for every (x level, y level) pair, zeros included, pairs with a NULL excluded.

    Any number of levels in the long form; ``wide`` has a column per level of y, at most ``MAX_LEVELS``.
    """
    if check_qualitative:
        for c in (x, y):
            if not is_qualitative(df, c):
                raise ValueError(f"{c!r} is not qualitative")
    counts = pair_counts(df, x, y)
    cells = dense_cells(counts, counts.select("x").distinct(), counts.select("y").distinct())
    cells = cells.select(F.col("x").alias(x), F.col("y").alias(y), F.col("n").alias("count"))
    if wide:
        levels = [r[0] for r in counts.select("y").distinct().orderBy("y").limit(S.MAX_LEVELS + 1).collect()]
        if len(levels) > S.MAX_LEVELS:
            raise ValueError(f"{y!r} has more than {S.MAX_LEVELS} levels; the wide form has a column for each")
        return cells.groupBy(x).pivot(y, levels).agg(F.first("count")).orderBy(x)
    return cells


def column_profiles(df: DataFrame, x: str, y: str) -> DataFrame:
    """Within each level of y, the share of each level of x (zero cells kept)."""
    counts = pair_counts(df, x, y)
    cells = dense_cells(counts, counts.select("x").distinct(), counts.select("y").distinct())
    share = F.try_divide(F.col("n").cast("double"), F.col("y_total").cast("double"))
    return cells.join(level_totals(counts, "y"), "y").select(
        F.col("x").alias(x), F.col("y").alias(y), F.col("n").alias("count"), share.alias("proportion"))


# B9 -----------------------------------------------------------------------------------
def cramers_v(df: DataFrame, x: str, y: str, digits: int | None = STAT_DECIMALS) -> DataFrame:
    """Cramer's V without continuity correction; NULL when a side has one level."""
    for c in (x, y):
        if not is_qualitative(df, c):
            raise ValueError(f"{c!r} is not qualitative")
    levels = (F.least("n_x", "n_y") - 1).cast("double")
    return chi_square_share(pair_counts(df, x, y)).select(
        rounded(F.sqrt(F.try_divide(F.col("phi2"), levels)), digits).alias("cramers_v"))


# B10 ----------------------------------------------------------------------------------
def relate(df: DataFrame, x: str, y: str) -> dict:
    """Choose the statistics by the column types, as the exploration page does.

    numeric-numeric -> regression line + Pearson r; categorical-numeric ->
    correlation ratio + parallel boxes; qualitative-qualitative -> contingency
    table, Cramer's V; column profiles only for two text or factor columns.
    """
    xn = is_numeric(df, x) and not is_factor(df, x)
    yn = is_numeric(df, y) and not is_factor(df, y)
    out: dict = {}
    if xn and yn:
        out["kind"] = "numeric-numeric"
        out["regression_line"] = regression_line(df, x, y)
        out["pearson"] = pearson(df, x, y)
    if _categorical(df, x) and yn:
        out["kind"] = "categorical-numeric"
        out["correlation_ratio"] = correlation_ratio(df, x, y)
        out["box_by"] = box_stats(df, y, by=x)
    if is_qualitative(df, x) and is_qualitative(df, y):
        out.setdefault("kind", "qualitative-qualitative")
        out["contingency"] = contingency(df, x, y)
        out["cramers_v"] = cramers_v(df, x, y)
    if _categorical(df, x) and _categorical(df, y):
        out.setdefault("kind", "qualitative-qualitative")
        out["column_profiles"] = column_profiles(df, x, y)
    if "kind" not in out:
        raise ValueError(f"no statistic for the pair ({x!r}, {y!r})")
    return out
