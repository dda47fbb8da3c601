"""Training rows of a few distinct values, many rows and few steps; incomplete rows of a wide correlation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.functions.moments import correlations
from loom.operators import models as M
from loom.operators import svm as SVM


def laid(rows, n):
    data = rows.select("a", "__label", F.xxhash64("__label", "a").alias("__row"))
    return M._laid_out(data, n, 1).select("a", F.spark_partition_id().alias("p")).groupBy("p", "a").count().collect()


def test_copies_of_a_frequent_row_are_spread_and_kept(spark):
    n = 500_000
    rows = spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.col("id") % 2).cast("double").alias("a"),
        (F.col("id") % 2).cast("double").alias("__label"))
    got = laid(rows, n)
    sizes = {}
    for r in got:
        sizes[r.p] = sizes.get(r.p, 0) + r["count"]
    assert sum(sizes.values()) == n and max(sizes.values()) < n / 4
    for value, copies in ((0.0, 200_001), (1.0, 250_000)):
        assert sum(r["count"] for r in got if r.a == value) == copies
    assert sum(1 for r in got if r.a > 1) == 49_999
    assert sorted(got) == sorted(laid(rows.repartition(3), n))


def test_tasks_of_a_step_grow_slowly_with_the_rows():
    assert M._train_partitions(5, 2) == 1 and M._train_partitions(60_000, 2) == 3
    assert M._train_partitions(36_000_000, 2) <= 30 and M._train_partitions(216_000_000, 4) <= 50
    assert M._train_partitions(216_000_000, 64) * M.TRAIN_PARTITION_BYTES >= 216_000_000 * 64 * 8


def test_incomplete_rows_leave_the_matrix_without_a_filter(spark):
    r = np.random.default_rng(4)
    full = r.normal(size=(200, 3))
    rows = [tuple(map(float, v)) for v in full] + [(None, 9.0, 9.0), (9.0, float("nan"), -9.0), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    res = correlations(df, ["a", "b", "c"])
    want = np.corrcoef(full.T)
    for row in res.collect():
        assert row.r == pytest.approx(want["abc".index(row.x), "abc".index(row.y)])
    assert "Filter" not in res._jdf.queryExecution().executedPlan().toString()


def test_small_tables_use_idle_cores_for_more_fits(spark):
    cores = spark.sparkContext.defaultParallelism
    assert SVM._fits_at_once(spark.range(10).repartition(1)) == max(SVM.PARALLEL_FITS, min(SVM.MOST_FITS, cores))
    assert SVM._fits_at_once(spark.range(10).repartition(3 * cores)) == SVM.PARALLEL_FITS
