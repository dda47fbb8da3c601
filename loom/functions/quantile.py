"""Exact order statistics and type-7 quantiles that scale.

Spark's exact ``percentile`` keeps a value->count map per group and merges the
maps of a group in one task; on a continuous column of a very large table that
map holds every distinct value.  Here quantiles come from *radix selection*:

* every double maps to a 64-bit key of the same order (``sort_key``: sign,
  binary exponent and mantissa, computed with SQL arithmetic);
* the first pass counts rows per (group, leading 12 bits) and picks, per
  wanted rank, the bucket that holds it; each further pass counts the next 12
  bits of the rows inside the picked buckets only (a range filter on the
  column, pushed into the scan when there is no grouping).  A bucket of at most
  ``leaf_rows`` rows is counted by whole keys, which ends its search;
* 64 bits are used up after at most six passes, whatever the spread of the
  values; infinities and NaN have keys of their own.

Tables that reach the driver hold one row per (group, wanted rank).  With more
than ``MAX_LEVELS`` groups nothing is collected: distinct (group, value) counts
are range-partitioned and the ranks found by running sums.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session as S
from .running import running_sums
from .stats import col, spark_interpolate

_X, _G, _K = "__qx", "__qg", "__qk"
BITS = 12
LEAF_ROWS = 100_000
_TINY = 2.0 ** -1022           # below it doubles have no implicit leading bit
_INF_KEY = 0x7FF << 52
_NAN_KEY = 0x7FF8 << 48        # NaN sorts above infinity, as in Spark


# keys ---------------------------------------------------------------------------------
def sort_key(df: DataFrame, x: str, out: str = _K) -> DataFrame:
    """Add the order-preserving 64-bit key of the double column ``x`` (equal values, -0.0 and 0.0 too, share a key).

    The key is sign * (biased exponent * 2^52 + mantissa); every step is exact in double arithmetic.
    """
    a, e, p = "__ka", "__ke", "__kp"
    names = df.columns
    size = F.abs(col(x))
    plain = (size >= F.lit(_TINY)) & (size < F.lit(math.inf))
    out_df = df.withColumn(a, F.when(plain, size).otherwise(F.lit(1.0)))
    out_df = out_df.withColumn(e, F.floor(F.log2(a)))
    out_df = out_df.withColumn(p, F.pow(F.lit(2.0), col(e)))
    # log2 may be off by one next to a power of two
    out_df = out_df.withColumn(e, col(e) - (col(a) < col(p)).cast("long") + (col(a) >= 2 * col(p)).cast("long"))
    fraction = ((col(a) / F.pow(F.lit(2.0), col(e)) - 1) * F.lit(2.0 ** 52)).cast("long")
    bits = (F.when(F.isnan(col(x)), F.lit(_NAN_KEY)).when(size == F.lit(math.inf), F.lit(_INF_KEY))
            .when(size < F.lit(_TINY), (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long"))
            .otherwise((col(e) + 1023) * F.lit(2 ** 52) + fraction))
    return out_df.select(*[col(n) for n in names], F.when(col(x) < 0, -bits).otherwise(bits).alias(out))


def key_of(value: float) -> int:
    if math.isnan(value):
        return _NAN_KEY
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def value_of(key: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def _rank_positions(n: int, p: float) -> tuple[int, int, float]:
    pos = (n - 1) * p
    lo = int(math.floor(pos))
    hi = int(math.ceil(pos))
    return lo + 1, hi + 1, pos


# quantiles ----------------------------------------------------------------------------
def quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: str | None = None,
    names: Sequence[str] | None = None,
    leaf_rows: int = LEAF_ROWS,
    bits: int = BITS,
) -> DataFrame:
    """Exact type-7 quantiles of ``column`` (NULLs ignored), optionally per ``by``.

    Returns a DataFrame with ``by`` (if given) and one double column per prob.
    A group (or table) without non-NULL values gives NULLs.
    """
    names = list(names or [f"q{p}" for p in probs])
    base = df.select((col(by) if by else F.lit(0)).alias(_G), col(column).cast("double").alias(_X))
    data = base.where(F.col(_X).isNotNull())
    spark = df.sparkSession
    by_type = df.schema[by].dataType if by else None

    def wanted(n: Column) -> Column:
        at = [(n - 1) * F.lit(float(p)) for p in probs]
        return F.array_distinct(F.array(*[f(a) + 1 for a in at for f in (F.floor, F.ceil)]))
    first = _first_pass(data, wanted, S.MAX_LEVELS * 2 * len(probs))
    groups = list(dict.fromkeys(r[_G] for r in first or ()))
    if first is None or len(groups) > S.MAX_LEVELS:
        out = _sorted_quantiles(data, probs, names)
    else:
        index = {g: i for i, g in enumerate(groups)}
        sizes = {index[r[_G]]: r["n"] for r in first}
        start = {(index[r[_G]], r["rank"]): (r["lo"], r["hi"], r["below"], r["cnt"]) for r in first}
        values = _select(data, by_type, groups, start, leaf_rows, bits)
        rows = []
        for g, i in index.items():
            found = []
            for p in probs:
                lo, hi, pos = _rank_positions(sizes[i], p)
                found.append(spark_interpolate(values[(i, lo)][0], values[(i, hi)][0], pos))
            rows.append(([g] if by else []) + found)
        if not by and not rows:
            rows = [[None] * len(names)]
        fields = ([T.StructField(_G, by_type, True)] if by else []) + [
            T.StructField(nm, T.DoubleType(), True) for nm in names]
        out = spark.createDataFrame(rows, T.StructType(fields))
    if not by:
        return out
    # groups whose values are all NULL have no ranks: they come from the table itself
    keys = base.select(F.col(_G).alias("__qkey")).distinct()
    return (keys.join(out, F.col("__qkey").eqNullSafe(F.col(_G)), "left")
            .select(F.col("__qkey").alias(by), *[col(nm) for nm in names]))


def quantile_values(df: DataFrame, column: str, probs: Sequence[float], **kw) -> list[float | None]:
    """Ungrouped convenience: the quantiles as Python floats (one row collected)."""
    row = quantiles(df, column, probs, **kw).first()
    return [row[i] for i in range(len(probs))]


def multi_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict:
    """Exact quantiles of several numeric columns in shared passes.

    The columns are stacked into (column index, value) pairs inside each task
    (a generator feeding a partial aggregate, so no row copies are shuffled)
    and resolved as one grouped problem.  Returns ``{column: [q per prob]}``;
    a column without non-NULL values gives NULLs.
    """
    cols = list(cols)
    if not cols:
        return {}
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("g"), col(c).cast("double").alias("x")) for i, c in enumerate(cols)])).alias("s"))
    stacked = stacked.select(F.col("s.g").alias("g"), F.col("s.x").alias("x")).where(F.col("x").isNotNull())
    rows = quantiles(stacked, "x", probs, by="g", **kw).collect()
    found = {r[0]: [r[i + 1] for i in range(len(probs))] for r in rows}
    return {c: found.get(i, [None] * len(probs)) for i, c in enumerate(cols)}


def kth_smallest(df: DataFrame, column: str, ranks: dict, by: str | None = None,
                 leaf_rows: int = LEAF_ROWS, bits: int = BITS, sizes: dict | None = None,
                 domain: tuple | None = None, with_counts: bool = False) -> dict:
    """Exact k-th smallest values of a numeric column (NULLs ignored).

    ``ranks`` maps a group value (``None`` key when ungrouped) to a list of
    1-based ranks (a bounded dictionary of the caller's).  Returns
    ``{(group, rank): value}``, or with ``with_counts`` (value, rows below it,
    rows equal to it).  When the caller already knows the non-NULL count per
    group (``sizes``) and a value range containing every value (``domain``,
    e.g. the range of a hash), the first pass starts from that range.
    """
    spark = df.sparkSession
    by_type = df.schema[by].dataType if by else None
    data = (df.select((col(by) if by else F.lit(0)).alias(_G), col(column).cast("double").alias(_X))
            .where(F.col(_X).isNotNull()))
    groups = list(ranks)
    if sizes is not None and domain is not None:
        lo, hi = (key_of(float(v)) for v in domain)
        start = {(i, r): (lo, hi, 0, sizes[g]) for i, g in enumerate(groups) for r in set(ranks[g])
                 if 0 < r <= sizes.get(g, 0)}
    else:
        asked = spark.createDataFrame(
            [(i, g if by else 0, sorted(set(ranks[g]))) for i, g in enumerate(groups) if ranks[g]],
            T.StructType([T.StructField("gi", T.IntegerType()), T.StructField("ag", by_type or T.IntegerType()),
                          T.StructField("ranks", T.ArrayType(T.LongType()))]))
        few = data.join(F.broadcast(asked), F.col(_G).eqNullSafe(F.col("ag"))).select(F.col("gi").alias(_G), _X, "ranks")
        first = _first_pass(few, None, sum(len(set(r)) for r in ranks.values()))
        start = {(r[_G], r["rank"]): (r["lo"], r["hi"], r["below"], r["cnt"]) for r in first}
    found = _select(data, by_type, groups if by else [0], start, leaf_rows, bits)
    return {(groups[i], r): (v if with_counts else v[0]) for (i, r), v in found.items()}


# radix selection ----------------------------------------------------------------------
def _first_pass(data: DataFrame, wanted: Callable[[Column], Column] | None, limit: int) -> list | None:
    """Per group and wanted rank the bucket of leading bits that holds it; None beyond ``limit`` rows.

    ``wanted`` gives the ranks from the group's size; without it, data carries them in the column ``ranks``.
    """
    keyed = sort_key(data, _X)
    aggs = [F.count("*").alias("cnt"), F.min(_K).alias("lo"), F.max(_K).alias("hi")]
    if wanted is None:
        aggs.append(F.first("ranks").alias("ranks"))
    hist = keyed.groupBy(_G, F.shiftright(_K, 64 - BITS).alias("top")).agg(*aggs)
    w = Window.partitionBy(_G)
    hist = hist.select("*", F.sum("cnt").over(w).alias("n"),
                       (F.sum("cnt").over(w.orderBy("top")) - F.col("cnt")).alias("below"))
    ranks = F.col("ranks") if wanted is None else wanted(F.col("n"))
    hit = (hist.withColumn("ranks", F.filter(ranks, lambda r: (r > F.col("below")) & (r <= F.col("below") + F.col("cnt"))))
           .select(_G, "n", "below", "cnt", "lo", "hi", F.explode("ranks").alias("rank")))
    rows = hit.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _select(data: DataFrame, by_type, groups: list, start: dict, leaf_rows: int, bits: int) -> dict:
    """{(group index, rank): (value, rows below it, rows equal to it)}, one pass per level of digits.

    ``start`` gives per (group index, rank) a range of keys that holds it: (lo, hi, rows below lo, rows in it).
    """
    found, active = {}, dict(start)
    while True:
        found.update({k: (value_of(lo), below, cnt) for k, (lo, hi, below, cnt) in active.items() if lo == hi})
        active = {k: v for k, v in active.items() if k not in found}
        if not active:
            return found
        # ranks that share a range share its counts
        ranges = {r: i for i, r in enumerate(dict.fromkeys((k[0], *v) for k, v in active.items()))}
        rows = [(i, groups[g], value_of(lo), value_of(hi),
                 0 if cnt <= leaf_rows else max(0, (hi - lo).bit_length() - bits))
                for (g, lo, hi, _below, cnt), i in ranges.items()]
        asked = {(ranges[(k[0], *v)], k[1] - v[2]) for k, v in active.items()}
        hits = _digit_pass(data, by_type, rows, sorted(asked))
        active = {k: (h["lo"], h["hi"], v[2] + h["below"], h["cnt"]) for k, v in active.items()
                  for h in [hits[(ranges[(k[0], *v)], k[1] - v[2])]]}


def _in_ranges(data: DataFrame, by_type, rows: list) -> DataFrame:
    """Rows of ``data`` in one of the ranges, tagged with its number and its digits' shift."""
    if by_type is None and len(rows) <= 64:
        # ungrouped: literal range predicates (pushed into the scan as range filters)
        rid = shift = None
        for i, _g, lo, hi, s in rows:
            inside = F.col(_X).between(F.lit(lo), F.lit(hi))
            rid = F.when(inside, F.lit(i)) if rid is None else rid.when(inside, F.lit(i))
            shift = F.when(inside, F.lit(s)) if shift is None else shift.when(inside, F.lit(s))
        low, high = min(r[2] for r in rows), max(r[3] for r in rows)
        return (data.where(F.col(_X).between(F.lit(low), F.lit(high)))
                .select(_X, rid.alias("rid"), shift.alias("shift")).where(F.col("rid").isNotNull()))
    table = data.sparkSession.createDataFrame(rows, T.StructType([   # bounded by MAX_LEVELS groups x ranks
        T.StructField("rid", T.IntegerType()), T.StructField("rg", by_type or T.IntegerType()),
        T.StructField("rlo", T.DoubleType()), T.StructField("rhi", T.DoubleType()),
        T.StructField("shift", T.IntegerType())]))
    return (data.join(F.broadcast(table), F.col(_G).eqNullSafe(F.col("rg")))
            .where(F.col(_X).between(F.col("rlo"), F.col("rhi"))).select(_X, "rid", "shift"))


def _digit_pass(data: DataFrame, by_type, rows: list, asked: list) -> dict:
    """{(range, rank in it): its digit's bucket} from one count of the rows in the ranges by their next digit."""
    keyed = sort_key(_in_ranges(data, by_type, rows), _X)
    hist = keyed.groupBy("rid", F.expr(f"shiftright({_K}, shift)").alias("digit")).agg(
        F.count("*").alias("cnt"), F.min(_K).alias("lo"), F.max(_K).alias("hi"))
    w = Window.partitionBy("rid").orderBy("digit")
    hist = hist.withColumn("below", F.sum("cnt").over(w) - F.col("cnt"))
    want = data.sparkSession.createDataFrame(asked, "rid int, rank long")
    hits = (hist.join(F.broadcast(want), "rid")
            .where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("cnt")))
            .select("rid", "rank", "below", "cnt", "lo", "hi").collect())
    return {(h["rid"], h["rank"]): h for h in hits}


# any number of groups -----------------------------------------------------------------
def _sorted_quantiles(data: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles per group from one global sort of the distinct (group, value) counts; nothing is collected."""
    counts = data.groupBy(_G, _X).agg(F.count("*").alias("cnt"))
    cum = running_sums(counts, _X, ["cnt"], by=_G)
    sizes = data.groupBy(F.col(_G).alias("__qs")).agg(F.count("*").alias("n"))
    placed = cum.join(sizes, F.col(_G).eqNullSafe(F.col("__qs")))

    def at(rank: Column) -> Column:
        here = (F.col("cum_cnt") - F.col("cnt") < rank) & (rank <= F.col("cum_cnt"))
        return F.max(F.when(here, F.col(_X)))
    parts, out = [], []
    for i, (p, nm) in enumerate(zip(probs, names)):
        pos = (F.col("n") - 1) * F.lit(float(p))
        parts += [at(F.floor(pos) + 1).alias(f"lo{i}"), at(F.ceil(pos) + 1).alias(f"hi{i}")]
        # written as Spark's percentile evaluates it
        out.append(F.when(F.floor(pos) == F.ceil(pos), F.col(f"lo{i}")).otherwise(
            (F.ceil(pos) - pos) * F.col(f"lo{i}") + (pos - F.floor(pos)) * F.col(f"hi{i}")).alias(nm))
    return placed.groupBy(_G, "n").agg(*parts).select(_G, *out)
