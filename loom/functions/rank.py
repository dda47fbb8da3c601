"""Seeded, partition-independent sampling ranks and bounded dictionaries.

Every sampled result depends only on (seed, key): rows are ordered by
``md5(concat(seed, ':', key))`` then ``key``.  Three building blocks:

* ``hash_threshold`` - the k-th row of that order (per group) found with the
  exact order-statistics refinement on a 52-bit numeric prefix of the hash; the
  sample is then a narrow filter against the threshold, no window, no shuffle
  of the rows themselves (holdout, undersampling);
* ``hash_rank`` - the full 1-based rank within a group, computed as bucket
  offsets (a bounded table of counts) plus a row_number inside each hash bucket,
  so a hot group is spread over many window partitions (oversampling);
* ``value_dictionary`` - distinct values of a column with their 1-based rank,
  broadcast when the level count is proven small, range-partitioned otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session as S
from .quantile import kth_smallest
from .running import running_sums
from .stats import FLOAT_TYPES, INTEGRAL_TYPES, col, stacked_values

HASH = "__h"
HNUM = "__h52"


def hash_expr(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), col(key).cast("string")))


def with_hash(df: DataFrame, seed, key: str) -> DataFrame:
    h = hash_expr(seed, key)
    # 13 hex digits = 52 bits: exactly representable as a double.
    return df.withColumn(HASH, h).withColumn(HNUM, F.conv(F.substring(h, 1, 13), 16, 10).cast("double"))


def _group_literal_case(by: str | None, groups: list, make: callable) -> Column:
    expr = None
    for gv in groups:
        cond = F.lit(True) if by is None else col(by).eqNullSafe(F.lit(gv))
        value = make(gv)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def _thresholds(df: DataFrame, key: str, k_by_group: dict, by: str | None, sizes: dict | None) -> dict:
    """{group: (prefix, hash, key) of its k-th row, hash and key None if the prefix decides; None keeps every row}."""
    sizes = None if sizes is None else {g: n for g, n in sizes.items()}
    ranks = {g: [k] for g, k in k_by_group.items() if k > 0 and (sizes is None or k <= sizes.get(g, 0))}
    found = kth_smallest(df, HNUM, ranks, by=by, sizes=sizes, domain=(0.0, float(2 ** 52 - 1))
                         if sizes is not None else None, with_counts=True) if ranks else {}
    if len(ranks) > S.MAX_LEVELS:
        raise ValueError(f"more than {S.MAX_LEVELS} groups")
    thresholds = {g: None for g, k in k_by_group.items() if k > 0 and (g, k) not in found}  # k >= size: keep all
    values = {}
    for g, k in k_by_group.items():
        if k > 0 and (g, k) in found:
            v, n_below, n_equal = found[(g, k)]
            if n_equal == 1:
                thresholds[g] = (v, None, None)  # the k-th row alone holds this prefix: keep prefix <= v
            else:
                values[g] = v
    if values:
        # Rare: several rows share the 52-bit prefix at the threshold.  One pass for all
        # such groups: rows strictly below it and the tied rows, ordered by full hash, key.
        v_of = _group_literal_case(by, list(values), lambda g: F.lit(values[g]))
        grp = [col(by).alias("__g")] if by else [F.lit(None).alias("__g")]
        below = {r["__g"]: r["n"] for r in df.where(F.col(HNUM) < v_of).groupBy(*grp).agg(F.count("*").alias("n"))
                 .collect()}
        ties = (df.where(F.col(HNUM) == v_of).select(*grp, F.col(HASH).alias("h"), col(key).alias("k"))
                .limit(S.BROADCAST_ROWS + 1).collect())
        if len(ties) > S.BROADCAST_ROWS:
            raise ValueError("hash prefix ties exceed the bound; key is not unique")
        by_group: dict = {}
        for t in ties:
            by_group.setdefault(t["__g"], []).append((t["h"], t["k"]))
        for g, v in values.items():
            tied = sorted(by_group.get(g, []))
            h, kv = tied[k_by_group[g] - below.get(g, 0) - 1]
            thresholds[g] = (v, h, kv)
    return thresholds


def _keeps(v: Column, h: Column, kv: Column, key: str) -> Column:
    """Row at or before the threshold row (prefix v, hash h, key kv; h NULL: the prefix decides)."""
    return F.when(h.isNull(), F.col(HNUM) <= v).otherwise(
        (F.col(HNUM) < v) | ((F.col(HNUM) == v) & ((F.col(HASH) < h) | ((F.col(HASH) == h) & (col(key) <= kv)))))


def hash_threshold_filter(df: DataFrame, key: str, k_by_group: dict, by: str | None = None,
                          sizes: dict | None = None) -> Column:
    """Boolean column: row is among the first k (per group) of the (hash, key) order.

    ``df`` must carry ``with_hash`` columns.  ``k_by_group`` maps group value
    (``None`` when ungrouped) to k.  Groups missing from the map keep no row;
    k >= group size keeps every row.  ``sizes`` (rows per group, if the caller
    counted them) lets the search start from the known hash range without a pass.
    """
    thresholds = _thresholds(df, key, k_by_group, by, sizes)
    ktype = df.schema[key].dataType

    def rule(g):
        th = thresholds[g]
        if th is None:
            return F.lit(True)
        return _keeps(F.lit(th[0]), F.lit(th[1]).cast("string"), F.lit(th[2]).cast(ktype), key)

    if not thresholds:
        return F.lit(False)
    expr = _group_literal_case(by, list(thresholds), rule)
    return F.coalesce(expr.otherwise(F.lit(False)), F.lit(False))


def hash_threshold_rows(df: DataFrame, key: str, k_by_group: dict, by: str, sizes: dict | None = None) -> DataFrame:
    """The rows ``hash_threshold_filter`` keeps, found by a join with the broadcast table of thresholds.

    ``k_by_group`` is bounded by MAX_LEVELS, and so is that table.
    """
    thresholds = _thresholds(df, key, k_by_group, by, sizes)
    schema = T.StructType([T.StructField("__tg", df.schema[by].dataType), T.StructField("__tv", T.DoubleType()),
                           T.StructField("__th", T.StringType()), T.StructField("__tk", df.schema[key].dataType)])
    table = df.sparkSession.createDataFrame(
        [(g, *(th or (None, None, None))) for g, th in thresholds.items()], schema)
    kept = F.col("__tv").isNull() | _keeps(F.col("__tv"), F.col("__th"), F.col("__tk"), key)
    return (df.join(F.broadcast(table), col(by).eqNullSafe(F.col("__tg"))).where(kept)
            .drop("__tg", "__tv", "__th", "__tk"))


def hash_rank(df: DataFrame, key: str, by: str, rank_col: str = "__rank", target_rows: int = 50_000) -> DataFrame:
    """1-based rank of each row within ``by`` in (hash, key) order, without a one-task window.

    ``df`` must carry ``with_hash`` columns.  Rows are bucketed by the top bits
    of the hash; bucket counts (bounded: groups x 2^bits) give each bucket's
    offset, and the window runs per (group, bucket).
    """
    n_max = df.groupBy(col(by)).count().agg(F.max("count")).first()[0] or 0
    bits = 0 if n_max <= target_rows else min(20, int(math.ceil(math.log2(n_max / target_rows))))
    bucket = F.floor(F.col(HNUM) / F.lit(float(2 ** (52 - bits)))).cast("long").alias("__bkt")
    tagged = df.withColumn("__bkt", bucket)
    counts = tagged.groupBy(col(by).alias("__g"), F.col("__bkt").alias("__obkt")).agg(F.count("*").alias("__n"))
    wb = Window.partitionBy("__g").orderBy("__obkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(wb), F.lit(0))).drop("__n")
    n_buckets = counts.count()
    right = F.broadcast(offsets) if n_buckets <= S.BROADCAST_ROWS else offsets
    joined = tagged.join(right, col(by).eqNullSafe(F.col("__g")) & (F.col("__bkt") == F.col("__obkt")))
    w = Window.partitionBy(col(by), F.col("__bkt")).orderBy(F.col(HASH), col(key))
    return (joined.withColumn(rank_col, (F.col("__off") + F.row_number().over(w)).cast("long"))
            .drop("__g", "__off", "__obkt", "__bkt"))


def value_dictionary(df: DataFrame, column: str, code_col: str = "code") -> tuple[DataFrame, int]:
    """Distinct non-NULL values of ``column`` with their 1-based sorted rank.

    Returns (dictionary, level_count).  Small dictionaries are ranked with a
    one-partition window over at most BROADCAST_ROWS rows; larger ones are
    range-partitioned, ranked inside each partition, and offset by the
    per-partition counts (a table with one row per partition).
    """
    distinct = S.cut_lineage(df.select(col(column).alias(column)).where(col(column).isNotNull()).distinct())
    n = distinct.count()              # written: each later use reads the values, not the table they come from
    if n <= S.BROADCAST_ROWS:
        ranked = distinct.withColumn(code_col, F.row_number().over(Window.orderBy(col(column))).cast("long"))
        return ranked, n
    parts = min(S.BROADCAST_ROWS, max(8, 4 * (n // 1_000_000 + 1)))  # offsets table is broadcast below
    ranged = (distinct.repartitionByRange(parts, col(column)).sortWithinPartitions(col(column))
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = S.cut_lineage(ranged)  # freeze the partition layout the offsets refer to
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    per_part = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    ranked = (ranged.join(F.broadcast(offsets), "__pid")
              .select(col(column), (F.col("__off") + local + 1).cast("long").alias(code_col)))
    return ranked, n


def value_dictionaries(df: DataFrame, columns) -> dict:
    """{column: (dictionary[value, __code], level count)} of several columns from one pass over ``df``.

    The columns are stacked into (column, value) pairs, made distinct with partial aggregation, and ranked within
    their column by running sums; the written dictionaries are read once per join.  Values keep their type's order:
    numbers in number slots, text (and booleans, dates and times, whose texts sort alike) in a text slot.
    """
    columns = list(columns)
    stackable = INTEGRAL_TYPES + FLOAT_TYPES + (T.StringType, T.BooleanType, T.DateType, T.TimestampType)
    plain = [c for c in columns if isinstance(df.schema[c].dataType, stackable)]
    out = {c: value_dictionary(df, c, code_col="__code") for c in columns if c not in plain or len(plain) == 1}
    if len(plain) < 2:
        return out
    pairs = (stacked_values(df, plain).where(F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull())
             .distinct())
    pairs = S.cut_lineage(pairs.withColumn("one", F.lit(1).cast("long")).withColumn("o", F.struct("l", "d", "s")))
    sizes = {r["g"]: r["count"] for r in pairs.groupBy("g").count().collect()}        # one row per column
    ranked = S.cut_lineage(running_sums(pairs, "o", ["one"], by="g").select("g", "l", "d", "s", "cum_one"))
    for i, c in enumerate(plain):
        t = df.schema[c].dataType
        slot = "l" if isinstance(t, INTEGRAL_TYPES) else "d" if isinstance(t, FLOAT_TYPES) else "s"
        out[c] = (ranked.where(F.col("g") == i).select(col(slot).cast(t).alias(c), F.col("cum_one").alias("__code")),
                  sizes.get(i, 0))
    return out


def join_dictionary(df: DataFrame, dictionary: DataFrame, n_levels: int, on: Column) -> DataFrame:
    """Left join of a dictionary; broadcast only under the proven size bound."""
    right = F.broadcast(dictionary) if n_levels <= S.BROADCAST_ROWS else dictionary
    return df.join(right, on, "left")
