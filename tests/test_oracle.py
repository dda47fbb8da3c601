"""Every registered query against its DuckDB oracle (the driver's correctness gate, on sf0.001)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from loom.plans import catalog
from oracle import compare, duck

from conftest import SMALL

SQL = oracle_sql()
NAMES = [n for n in catalog.QUERIES if n in SQL]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SMALL, queries(), SQL, con=con)
    assert ok, msg


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert {"column", "class", "missing", "median"} <= set(df.columns)


def test_every_query_has_oracle_or_is_a_flow():
    missing = [n for n in catalog.QUERIES if n not in SQL]
    assert all(n.startswith("recipe_") for n in missing), missing


@pytest.mark.parametrize("name", ["holdout_events", "downsample_priority", "upsample_status", "box_by_event_type",
                                  "label_encode_priority", "roc_points_rule"])
def test_results_do_not_depend_on_shuffle_partitions(spark, con, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        ok, msg = compare(spark, name, SMALL, queries(), SQL, con=con)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert ok, msg
