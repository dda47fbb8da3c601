"""One correlation path for any number of columns; category pairs with any number of levels."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loom import session as S
from loom.operators import evaluate as EV
from loom.operators import explore as EX


@pytest.mark.parametrize("k", [1, 2, 60, 61, 300])
def test_correlations_equal_numpy(spark, k):
    r = np.random.default_rng(k)
    m = r.normal(size=(200, k)) @ r.normal(size=(k, k)) + 1e6
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in m], [f"c{i}" for i in range(k)]).repartition(5)
    t = time.time()
    got = {(x, y): v for x, y, v in EX.corr_matrix(df).collect()}
    assert time.time() - t < 30
    want = np.atleast_2d(np.corrcoef(m, rowvar=False))
    assert len(got) == k * (k + 1) // 2
    assert all(got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(k) for j in range(i, k))


@pytest.mark.parametrize("k", [2, 61])
def test_correlations_without_complete_rows(spark, k):
    schema = ", ".join(f"c{i} double" for i in range(k))
    for rows in ([], [(None,) + (1.0,) * (k - 1)], [(2.0,) * k]):
        got = EX.corr_matrix(spark.createDataFrame(rows, schema)).collect()
        assert all(r.r == (1.0 if r.x == r.y else None) for r in got) and len(got) == k * (k + 1) // 2


def test_correlation_of_infinite_values_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0), (2.0, 5.0)], "a double, b double")
    assert {(r.x, r.y): r.r for r in EX.corr_matrix(df).collect()} == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): None}


def chi_v(pairs):
    xs, ys = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    o = np.zeros((len(xs), len(ys)))
    for a, b in pairs:
        o[xs.index(a), ys.index(b)] += 1
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return float(np.sqrt(((o - e) ** 2 / e).sum() / (o.sum() * (min(o.shape) - 1))))


def test_cramers_v_equals_the_dense_formula(spark):
    r = np.random.default_rng(1)
    pairs = [(f"x{a}", f"y{(a * b) % 7}") for a, b in r.integers(0, 9, (400, 2))]
    df = spark.createDataFrame(pairs + [(None, "y1"), ("x1", None)], "x string, y string")
    assert EX.cramers_v(df, "x", "y", digits=9).first()[0] == pytest.approx(chi_v(pairs), abs=1e-8)
    one = spark.createDataFrame([("a", "b"), ("a", "c")], "x string, y string")
    assert EX.cramers_v(one, "x", "y").first()[0] is None
    assert EX.cramers_v(one.limit(0), "x", "y").first()[0] is None


def test_twenty_thousand_levels(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("x"),
                                    (F.col("id") % 3).cast("string").alias("y"))
    assert EX.cramers_v(df, "x", "y", digits=6).first()[0] == pytest.approx(1.0 if 20_000 % 3 == 0 else 0.0, abs=1e-6)
    cells = EX.contingency(df, "x", "y")
    assert cells.count() == 60_000 and cells.agg(F.sum("count")).first()[0] == 60_000
    shares = EX.column_profiles(df, "x", "y").groupBy("y").agg(F.sum("proportion").alias("p")).collect()
    assert [s.p for s in shares] == pytest.approx([1.0] * 3)


def test_confusion_of_more_labels_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_LEVELS", 3)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 5)
    rows = [(f"l{i % 12}", f"l{i % 5}") for i in range(300)] + [(None, "l1"), ("l77", None)]
    df = spark.createDataFrame(rows, "actual string, predicted string")
    got = {(r.predicted, r.actual): r["count"] for r in EV.confusion_matrix(df).collect()}
    labels = {v for pair in rows for v in pair if v}
    assert got.keys() == {(a, b) for a in labels for b in labels}
    assert all(n == sum(r == (a, p) for r in rows) for (p, a), n in got.items())


def test_contingency_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert EX.contingency(df, "x", "y").count() == 0 and EX.column_profiles(df, "x", "y").count() == 0
