"""Range loads reach the scan and leave missing values out; deep pages equal direct pages."""

import math

import pytest

from loom.operators import profile as P
from loom.plans.inspect import physical_plan
from loom.sources import load
from loom.sources.readers import in_ranges

ROWS = [(1, 1.0, "a"), (2, math.nan, "b"), (3, None, "c"), (4, 7.5, None), (5, math.inf, "e"), (6, -math.inf, "f"), (None, 3.0, "g")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranges") / "t.parquet")
    spark.createDataFrame(ROWS, "id long, value double, name string").write.parquet(path)
    return path


@pytest.mark.parametrize("ranges, ids", [
    ({}, {1, 2, 3, 4, 5, 6, None}),
    ({"value": (0, 10)}, {1, 4, None}),
    ({"value": (0, None)}, {1, 4, 5, None}),               # NaN sorts above all numbers and still stays out
    ({"value": (None, 5)}, {1, 6, None}),
    ({"value": (None, None)}, {1, 4, 5, 6, None}),
    ({"value": (0, 10), "id": (2, None)}, {4}),
    ({"name": ("b", "f")}, {2, 3, 5, 6}),
    ({"value": (9, 2)}, set()),
])
def test_range_loads(spark, stored, ranges, ids):
    assert {r.id for r in load(spark, stored, ranges=ranges).collect()} == ids


def test_ranges_reach_the_scan(spark, stored):
    plan = physical_plan(load(spark, stored, ranges={"value": (0, 10)}).select("id"))
    scan = next(line for line in plan.splitlines() if "Scan parquet" in line)
    assert "GreaterThanOrEqual(value,0.0)" in scan and "LessThanOrEqual(value,10.0)" in scan
    assert "name" not in scan.split("ReadSchema")[1]


def test_ranges_of_csv_and_unknown_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\nNA,y\n3,z\nNaN,w\n")
    assert [r.b for r in load(spark, str(path), ranges={"a": (2, None)}).collect()] == ["z"]
    with pytest.raises(ValueError, match="no such columns"):
        in_ranges(load(spark, str(path)), {"c": (0, 1)})


def pages(df, **options):
    return [[tuple(r) for r in P.browse(df, page=n, page_size=7, **options).collect()] for n in (1, 2, 5, 14, 15, 16)]


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_equal_direct_pages(spark, descending):
    df = spark.createDataFrame([(k, None if k % 9 == 0 else float(k % 5), f"n{k % 3}") for k in range(103)],
                               "id long, value double, name string").repartition(5)
    options = dict(order_by=["value"], descending=descending, key="id")
    direct, deep = pages(df, **options), pages(df, direct_rows=0, **options)
    assert deep == direct and [len(p) for p in deep] == [7, 7, 7, 7, 5, 0]
    found = dict(search="n1", **options)
    assert pages(df, direct_rows=0, **found) == pages(df, **found)


def test_deep_pages_of_repeated_rows_cover_the_table(spark):
    rows = [(1, "x")] * 60 + [(k % 4, f"y{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(4)
    got = [tuple(r) for n in range(1, 12) for r in P.browse(df, order_by="a", page=n, page_size=10, direct_rows=0).collect()]
    assert sorted(got) == sorted(rows) and [r[0] for r in got] == sorted(r[0] for r in rows)
    assert P.browse(df.limit(0), order_by="a", page=3, direct_rows=0).count() == 0


def test_deep_pages_of_many_parts(spark):
    df = spark.range(5000).selectExpr("id", "id * 7919 % 5000 as v")
    want = [r.v for r in P.browse(df, order_by="v", page=71, page_size=50).collect()]
    out = P._deep_page(df, [df["v"].asc()], 3500, 50, rows_per_part=100)
    assert [r.v for r in out.collect()] == want == list(range(3500, 3550))
