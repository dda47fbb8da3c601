"""Property checks of SURVEY section 5.2 on the driver's sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from loom.operators import clean as CL
from loom.operators import encode as EN
from loom.operators import evaluate as EV
from loom.operators import explore as EX
from loom.operators import sampling as SA
from loom.operators import scale as SC
from loom.workspace import Workspace


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SMALL}/orders.parquet")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


def test_minmax_in_unit_interval(spark, orders):
    ws = SC.scale(Workspace.from_df(orders, "o_orderkey"), ["o_totalprice"], "minmax")
    r = ws.working().agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    assert r["lo"] == 0.0 and r["hi"] == 1.0
    # the raw copy is untouched
    assert ws.display().agg(F.max("o_totalprice")).first()[0] > 1.0


def test_zscore_moments(spark, orders):
    ws = SC.scale(Workspace.from_df(orders, "o_orderkey"), ["o_totalprice"], "zscore")
    r = ws.working().agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1.0)


def test_outlier_removal_leaves_inside_original_fences(spark, events):
    b = CL.iqr_bounds(events, "value")
    ws = CL.treat_outliers(Workspace.from_df(events, "event_id"), "value", "remove")
    r = ws.working().agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    assert r["lo"] >= b["lower"] and r["hi"] <= b["upper"]


def test_holdout_exact_disjoint_and_partition_independent(spark, events):
    n = events.count()
    a = SA.holdout(events.select("event_id"), "event_id", 0.7, seed=7)
    b = SA.holdout(events.select("event_id").repartition(5), "event_id", 0.7, seed=7)
    ta = {r[0] for r in a.where("split = 'train'").select("event_id").collect()}
    tb = {r[0] for r in b.where("split = 'train'").select("event_id").collect()}
    assert len(ta) == int(0.7 * n) and ta == tb
    assert a.count() == n


def test_holdout_refinement_path_matches_window(spark, events):
    """Force the multi-level threshold search and compare with a global row_number."""
    from loom.functions import quantile as Q
    from loom.functions.rank import HASH, HNUM, hash_threshold_filter, with_hash
    df = with_hash(events.select("event_id"), 11, "event_id")
    k = 333
    orig = Q.kth_smallest.__defaults__
    Q.kth_smallest.__defaults__ = (None, 50, 3, None, None, False)  # by, leaf, bits, sizes, domain, counts
    try:
        keep = hash_threshold_filter(df, "event_id", {None: k})
        got = {r[0] for r in df.where(keep).select("event_id").collect()}
    finally:
        Q.kth_smallest.__defaults__ = orig
    from pyspark.sql import Window
    w = Window.orderBy(HASH, "event_id")
    want = {r[0] for r in df.withColumn("rn", F.row_number().over(w)).where(f"rn <= {k}").select("event_id").collect()}
    assert got == want and len(got) == k
    assert HNUM in df.columns


def test_downsample_equal_classes(spark, orders):
    out = SA.downsample(orders, "o_orderpriority", "o_orderkey", seed=3)
    counts = [r["count"] for r in out.groupBy("o_orderpriority").count().collect()]
    assert len(set(counts)) == 1


def test_upsample_superset_and_balanced(spark, orders):
    out = SA.upsample(orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", seed=3)
    counts = [r["count"] for r in out.groupBy("o_orderstatus").count().collect()]
    assert len(set(counts)) == 1
    assert out.where("draw = 0").count() == orders.count()


def test_upsample_bucketed_rank_matches_window(spark, orders):
    from pyspark.sql import Window
    from loom.functions.rank import HASH, hash_rank, with_hash
    df = with_hash(orders.select("o_orderkey", "o_orderstatus"), 5, "o_orderkey")
    got = {(r[0], r[1]) for r in hash_rank(df, "o_orderkey", "o_orderstatus", target_rows=40)
           .select("o_orderkey", "__rank").collect()}
    w = Window.partitionBy("o_orderstatus").orderBy(HASH, "o_orderkey")
    want = {(r[0], r[1]) for r in df.withColumn("rk", F.row_number().over(w)).select("o_orderkey", "rk").collect()}
    assert got == want


def test_label_encoding_roundtrip(spark, orders):
    ws = EN.encode(Workspace.from_df(orders, "o_orderkey"), ["o_orderpriority"], "label")
    pairs = ws.df.select("o_orderpriority", ws.wcol("o_orderpriority")).distinct().collect()
    codes = {r[0]: r[1] for r in pairs}
    assert len(codes) == len(set(codes.values()))
    assert [codes[k] for k in sorted(codes)] == list(range(1, len(codes) + 1))


def test_large_dictionary_path(spark, orders, monkeypatch):
    from loom import session as S
    from loom.functions.rank import value_dictionary
    monkeypatch.setattr(S, "BROADCAST_ROWS", 10)
    d, n = value_dictionary(orders, "o_custkey")
    got = sorted((r[0], r[1]) for r in d.collect())
    vals = sorted(r[0] for r in orders.select("o_custkey").distinct().collect())
    assert got == [(v, i + 1) for i, v in enumerate(vals)] and n == len(vals)


def test_running_sums_large_path(spark, events, monkeypatch):
    from loom import session as S
    from loom.functions.running import running_sums
    per = events.groupBy("value").agg(F.count("*").alias("n"))
    small = {r["value"]: r["cum_n"] for r in running_sums(per, "value", ["n"]).collect()}
    monkeypatch.setattr(S, "BROADCAST_ROWS", 10)
    big = {r["value"]: r["cum_n"] for r in running_sums(per, "value", ["n"], partitions=7).collect()}
    assert small == big


def test_profiles_sum_to_one(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    prof = EX.column_profiles(li, "l_returnflag", "l_linestatus")
    for r in prof.groupBy("l_linestatus").agg(F.sum("proportion").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)


def test_auc_symmetry(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    df = li.select(F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("actual"),
                   F.col("l_quantity").alias("score"), (-F.col("l_quantity")).alias("neg"))
    a = EV.auc(df).first()[0]
    b = EV.auc(df, score="neg").first()[0]
    assert a + b == pytest.approx(1.0)


def test_accuracy_is_trace_over_total(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    df = li.select(F.col("l_returnflag").alias("actual"),
                   F.when(F.col("l_quantity") > 25, "R").otherwise("N").alias("predicted"))
    cm = EV.confusion_matrix(df).collect()
    trace = sum(r["count"] for r in cm if r["predicted"] == r["actual"])
    acc = {r["metric"]: r["value"] for r in EV.classification_metrics(df).collect()}["Accuracy"]
    assert acc == pytest.approx(trace / df.count())


def test_quantile_passes_match_percentile(spark, events):
    from loom.functions.quantile import quantiles
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    aggs = [F.percentile("value", p) for p in probs]
    b = quantiles(events, "value", probs, leaf_rows=20, bits=3).first()
    assert list(b) == pytest.approx(list(events.agg(*aggs).first()))
    ga = sorted(events.groupBy("event_type").agg(*aggs).collect())
    gb = sorted(quantiles(events, "value", probs, by="event_type", leaf_rows=20, bits=2).collect())
    for x, y in zip(ga, gb):
        assert x[0] == y[0] and list(x[1:]) == pytest.approx(list(y[1:]))


def test_threshold_with_prefix_ties_matches_window(spark, events):
    """Coarsen the numeric hash prefix so many rows share it: the tie path must still be exact."""
    from pyspark.sql import Window
    from loom.functions.rank import HASH, HNUM, hash_threshold_filter, with_hash
    df = with_hash(events.select("event_id", "event_type"), 5, "event_id")
    df = df.withColumn(HNUM, F.floor(F.col(HNUM) / F.lit(float(2 ** 47))).cast("double"))  # 32 prefix values
    sizes = {r[0]: r[1] for r in df.groupBy("event_type").count().collect()}
    k = {g: max(1, n // 3) for g, n in sizes.items()}
    keep = hash_threshold_filter(df, "event_id", k, by="event_type", sizes=sizes)
    got = {r[0] for r in df.where(keep).select("event_id").collect()}
    w = Window.partitionBy("event_type").orderBy(HASH, "event_id")
    ranked = df.withColumn("rn", F.row_number().over(w))
    want = set()
    for g, kk in k.items():
        want |= {r[0] for r in ranked.where((F.col("event_type") == g) & (F.col("rn") <= kk)).select("event_id").collect()}
    assert got == want
