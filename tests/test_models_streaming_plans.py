"""Models on learnable derived targets, save/load, streaming apply, plan checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from loom.operators import models as M
from loom.operators import svm as SVM
from loom.plans.inspect import has_python_udf, physical_plan


@pytest.fixture(scope="module")
def learn(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    return li.select("l_quantity", "l_discount", "l_tax",
                     (2 * F.col("l_quantity") + 300 * F.col("l_discount") + 5).alias("y_linear"),
                     F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y_binary"),
                     F.when(F.col("l_quantity") > 30, 40).otherwise(10).alias("y_step"))


FEATS = ["l_quantity", "l_discount", "l_tax"]


def test_linear_regression_recovers_coefficients(learn):
    fm = M.train(learn, "linear_regression", FEATS, label="y_linear")
    lr = fm.pipeline.stages[-1]
    assert list(lr.coefficients) == pytest.approx([2.0, 300.0, 0.0], abs=1e-6)
    assert lr.intercept == pytest.approx(5.0, abs=1e-6)
    imp = {r["feature"]: r["importance"] for r in M.feature_importance(fm).collect()}
    assert imp["l_discount"] == pytest.approx(300.0, abs=1e-6)


@pytest.mark.parametrize("kind", ["svm", "random_forest", "logistic_regression"])
def test_classifiers_learn_threshold(learn, kind):
    fm = M.train(learn, kind, FEATS, label="y_binary", trees=20)
    m = {r["metric"]: r["value"] for r in M.evaluate(fm, learn).collect()}
    assert m["Accuracy"] >= 0.95


def test_tree_learns_step(learn):
    fm = M.train(learn, "decision_tree", FEATS, label="y_step")
    m = {r["metric"]: r["value"] for r in M.evaluate(fm, learn).collect()}
    assert m["R2"] >= 0.99


def test_forest_importance_informative_first(learn):
    fm = M.train(learn, "random_forest", FEATS, label="y_binary", trees=10)
    rows = M.feature_importance(fm).collect()
    assert rows[0]["feature"] == "l_quantity"
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)


def test_poly_kernel_identity(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=4), rng.normal(size=4)
    feats = [f"x{i}" for i in range(4)]
    df = spark.createDataFrame([tuple(map(float, u)), tuple(map(float, v))], ", ".join(f"{f} double" for f in feats))
    gamma = 0.25
    phi = np.array([r[0] for r in df.select(SVM.cubic_map(feats, gamma)).collect()])
    assert phi.shape[1] == math.comb(4 + 2, 3)
    assert float(phi[0] @ phi[1]) == pytest.approx((gamma * float(u @ v)) ** 3)


def test_unknown_model_rejected(learn):
    with pytest.raises(ValueError):
        M.train(learn, "knn", FEATS, label="y_binary")


def test_save_load_same_predictions(learn, tmp_path):
    fm = M.train(learn, "decision_tree", FEATS, label="y_step")
    path = str(tmp_path / "model")
    M.save_model(fm, path)
    fm2 = M.load_model(path)
    a = M.predict(fm, learn).select("predicted").collect()
    b = M.predict(fm2, learn).select("predicted").collect()
    assert a == b


def test_streaming_apply_matches_batch(spark, tmp_path):
    from loom.streaming import apply_prep, fit_prep
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "value", "event_type")
    fitted = fit_prep(ev, scale={"minmax": ["value"]}, label_encode=["event_type"])
    src = str(tmp_path / "in")
    ev.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (apply_prep(stream, fitted).writeStream.format("memory").queryName("prep_out")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(spark.table("prep_out").collect())
    want = sorted(apply_prep(ev, fitted).collect())
    assert got == want


def test_no_python_udf_in_any_plan(spark):
    from __spark_entry__ import queries
    for name, fn in queries().items():
        if name.startswith("recipe_"):
            continue
        assert not has_python_udf(fn(spark, SMALL)), name


def test_outlier_removal_pushes_range_filter(spark):
    from loom.operators.clean import treat_outliers
    from loom.workspace import Workspace
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    out = treat_outliers(Workspace.from_df(ev, "event_id"), "value", "remove").working()
    plan = physical_plan(out)
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and "LessThanOrEqual(value" in pushed[0] and "IsNull(value)" in pushed[0]


def test_samples_are_filters_not_windows(spark):
    from loom.operators import sampling as SA
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    for df in (SA.holdout(orders, "o_orderkey", 0.7), SA.downsample(orders, "o_orderpriority", "o_orderkey")):
        plan = physical_plan(df)
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_label_encoding_broadcasts_bounded_dictionary(spark):
    from loom.operators.encode import encode
    from loom.workspace import Workspace
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = physical_plan(encode(Workspace.from_df(orders, "o_orderkey"), ["o_orderpriority"], "label").working())
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
