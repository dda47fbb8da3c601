"""Radix selection: keys, wide spreads, pass counts, any number of groups."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from loom import session as S
from loom.functions import quantile as Q


def doubles():
    r = random.Random(2)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
          math.inf, -math.inf, math.nan]
    xs += [2.0 ** e for e in range(-1074, 1024)]
    xs += [math.nextafter(2.0 ** e, d) for e in range(-1070, 1024) for d in (0.0, math.inf)]
    xs += [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(20_000)]
    return xs


def test_sort_key_equals_the_bits_of_every_kind_of_double(spark):
    xs = doubles()
    got = Q.sort_key(spark.createDataFrame([(x,) for x in xs], "x double"), "x").collect()
    for x, k in got:
        assert k == Q.key_of(x)
        back = Q.value_of(k)
        assert back == x or (math.isnan(back) and math.isnan(x))
    keys = sorted((Q.key_of(x), x) for x in xs if not math.isnan(x))
    assert [x for _, x in keys] == sorted(x for x in xs if not math.isnan(x))


def passes(monkeypatch):
    seen = []
    real = Q._digit_pass
    monkeypatch.setattr(Q, "_digit_pass", lambda *a: seen.append(1) or real(*a))
    return seen


@pytest.mark.parametrize("make", [
    lambda i: (1 if i % 2 else -1) * 1.7e308 * (1 - i * 1e-6),
    lambda i: 10.0 ** (i / 4 - 250),
    lambda i: -(10.0 ** (i / 4 - 250)) if i % 3 else 10.0 ** (249 - i / 4),
    lambda i: 1.0 + i * 2.0 ** -52,
], ids=["ends of the range", "500 decades", "both signs", "neighbours"])
def test_any_spread_ends_within_six_passes(spark, monkeypatch, make):
    xs = [make(i) for i in range(2000)]
    seen = passes(monkeypatch)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = Q.quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], leaf_rows=0).first()
    assert len(seen) <= 5                # and the first pass
    s = sorted(xs)
    for p, v in zip([0.0, 0.25, 0.5, 1.0], got):
        lo, hi, pos = Q._rank_positions(len(s), p)
        assert v == (s[lo - 1] if lo == hi else (hi - 1 - pos) * s[lo - 1] + (pos - lo + 1) * s[hi - 1])


def test_more_groups_than_the_driver_takes(spark, monkeypatch):
    rows = [(f"g{i % 40}" if i % 41 else None, float((i * 7919) % 1000) if i % 13 else None) for i in range(4000)]
    rows += [("hot", 1.0)] * 3000 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.9]
    want = {r[0]: list(r[1:]) for r in df.groupBy("g").agg(*[F.percentile("x", p) for p in probs]).collect()}
    few = {r[0]: list(r[1:]) for r in Q.quantiles(df, "x", probs, by="g").collect()}
    monkeypatch.setattr(S, "MAX_LEVELS", 5)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 100)      # the running sums take their range-partitioned way too
    many = {r[0]: list(r[1:]) for r in Q.quantiles(df, "x", probs, by="g").collect()}
    assert few.keys() == many.keys() == want.keys()
    for g, q in want.items():
        assert few[g] == pytest.approx(q) and many[g] == pytest.approx(q)


def test_empty_table_and_no_values(spark):
    assert list(Q.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()) == [None]
    none = spark.createDataFrame([(None,)], "x double")
    assert list(Q.quantiles(none, "x", [0.25, 0.5]).first()) == [None, None]
    assert Q.quantiles(spark.createDataFrame([], "g int, x double"), "x", [0.5], by="g").count() == 0


def test_kth_smallest_with_counts(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", 1.0), ("b", -3.0), ("b", None)], "g string, x double")
    got = Q.kth_smallest(df, "x", {"a": [1, 3], "b": [1, 2], "c": [1]}, by="g", with_counts=True)
    assert got == {("a", 1): (1.0, 0, 1), ("a", 3): (2.0, 1, 2), ("b", 1): (-3.0, 0, 1)}
