"""Inline edge tables (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from loom.functions.quantile import quantile_values
from loom.operators import clean as CL
from loom.operators import convert as CV
from loom.operators import encode as EN
from loom.operators import evaluate as EV
from loom.operators import explore as EX
from loom.operators import profile as P
from loom.operators import scale as SC
from loom.sources.readers import normalise_missing
from loom.workspace import Workspace


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_constant_column_scales_to_null(spark):
    df = frame(spark, [(1, 5.0), (2, 5.0), (3, 5.0)], "k int, x double")
    ws = Workspace.from_df(df, "k")
    for m in ("minmax", "zscore"):
        out = SC.scale(ws, ["x"], m).working().collect()
        assert all(r["x"] is None for r in out)
    assert EX.pearson(df.withColumn("y", F.col("k") * 1.0), "x", "y").first()["r"] is None


def test_mode_ties_take_smallest(spark):
    df = frame(spark, [(1, 2.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, None)], "k int, x double")
    out = CL.impute(Workspace.from_df(df, "k"), "x", "mode").working().where("k = 5").first()
    assert out["x"] == 1.0


def test_log_edges(spark):
    df = frame(spark, [(1, -2.0), (2, -1.0), (3, 0.0), (4, 1.0), (5, None)], "k int, x double")
    out = {r["k"]: r["x"] for r in SC.scale(Workspace.from_df(df, "k"), ["x"], "log").working().collect()}
    assert out[1] is None and out[2] == float("-inf") and out[3] == 0.0
    assert out[4] == pytest.approx(math.log(2)) and out[5] is None


def test_unscale_inverts_log(spark):
    df = frame(spark, [(1, 3.0), (2, 0.5)], "k int, x double")
    ws = SC.scale(Workspace.from_df(df, "k"), ["x"], "log")
    back = {r["k"]: r["x"] for r in SC.unscale(ws, ["x"]).working().collect()}
    assert back[1] == pytest.approx(3.0) and back[2] == pytest.approx(0.5)


def test_text_numbers_convert(spark):
    df = frame(spark, [(1, "3"), (2, "-4.5"), (3, "1-2"), (4, "--"), (5, None)], "k int, x string")
    ws, conv, failed = CV.cat_to_num(Workspace.from_df(df, "k"), ["x"])
    assert conv == ["x"] and failed == []
    got = {r["k"]: r["x"] for r in ws.working().collect()}
    assert got == {1: 3.0, 2: -4.5, 3: None, 4: None, 5: None}


def test_text_not_numbers_refused(spark):
    df = frame(spark, [(1, "3"), (2, "1e5")], "k int, x string")
    ws, conv, failed = CV.cat_to_num(Workspace.from_df(df, "k"), ["x"])
    assert conv == [] and failed == ["x"]
    assert ws.working().schema["x"].dataType.simpleString() == "string"


def test_num_to_cat_and_back_restores(spark):
    df = frame(spark, [(1, 100000.0), (2, 2.5)], "k int, x double")
    ws = CV.num_to_cat(Workspace.from_df(df, "k"), ["x"])
    assert {r["x"] for r in ws.working().collect()} == {"100000", "2.5"}
    ws2, conv, failed = CV.cat_to_num(ws, ["x"])
    assert conv == ["x"]
    assert {r["x"] for r in ws2.working().collect()} == {100000.0, 2.5}


def test_nan_counts_as_missing(spark):
    df = normalise_missing(frame(spark, [(1, 1.0), (2, float("nan")), (3, None)], "k int, x double"))
    s = P.summary(df).where("column = 'x'").first()
    assert s["missing"] == 2


def test_one_level(spark):
    df = frame(spark, [(1, "a", "u"), (2, "a", "v")], "k int, x string, y string")
    ws = EN.encode(Workspace.from_df(df, "k"), ["x"], "onehot")
    assert ws.work == ("y", "x_a")
    assert EX.cramers_v(df, "x", "y").first()["cramers_v"] is None


def test_all_null_column(spark):
    df = frame(spark, [(1, None), (2, None)], "k int, x string")
    s = P.summary(df).where("column = 'x'").first()
    assert s["missing"] == 2 and s["unique_values"] == 1
    ws, conv, _ = CV.cat_to_num(Workspace.from_df(df, "k"), ["x"])
    assert conv == ["x"]


def test_missing_predicted_class_zero_filled(spark):
    df = frame(spark, [("a", "a"), ("b", "a"), ("c", "a")], "actual string, predicted string")
    m = {r["metric"]: r["value"] for r in EV.classification_metrics(df).collect()}
    assert m["Accuracy"] == pytest.approx(1 / 3)
    assert m["Precision"] == pytest.approx((1 / 3) / 3)
    assert m["Recall"] == pytest.approx(1 / 3)
    cm = EV.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 3


def test_eta_null_denominators(spark):
    df = frame(spark, [("a", 1.0), ("a", None), ("b", 3.0), (None, 9.0)], "x string, y double")
    assert EX.correlation_ratio(df, "x", "y", digits=6).first()["eta"] == pytest.approx(0.720577, abs=1e-6)


def test_eta_all_null_group_is_null(spark):
    df = frame(spark, [("a", 1.0), ("b", None), ("a", 3.0)], "x string, y double")
    assert EX.correlation_ratio(df, "x", "y").first()["eta"] is None


def test_quartiles_type7(spark):
    df = frame(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    q1, med = quantile_values(df, "x", [0.25, 0.5])
    assert q1 == 1.75 and med == 2.5
    q1b, medb = quantile_values(df, "x", [0.25, 0.5], leaf_rows=0, bits=3)
    assert (q1b, medb) == (1.75, 2.5)


def test_outliers_keep_nulls_and_strict_fences(spark):
    rows = [(i, float(i)) for i in range(1, 21)] + [(21, 1000.0), (22, None)]
    df = frame(spark, rows, "k int, x double")
    ws = CL.treat_outliers(Workspace.from_df(df, "k"), "x", "remove")
    got = {r["k"] for r in ws.working().collect()}
    assert 21 not in got and 22 in got and len(got) == 21


def test_submitted_workspace_is_locked(spark):
    df = frame(spark, [(1, 1.0)], "k int, x double")
    ws = Workspace.from_df(df, "k").submit()
    with pytest.raises(ValueError):
        SC.scale(ws, ["x"], "minmax")


def test_unknown_file_type():
    from loom.sources.readers import file_format
    with pytest.raises(ValueError):
        file_format("data.txt")
    assert file_format("a/b.CSV") == "csv"


def test_formatted_summary_matches_display_format(spark):
    df = frame(spark, [(13.4, "a"), (29.0, "b"), (58.6, None)], "x double, s string")
    rows = {r["Column"]: r for r in P.summary(df, formatted=True).collect()}
    x, s = rows["x"], rows["s"]
    assert (x["Class"], x["Missing"], x["Min"], x["Median"], x["Max"]) == ("Numerical", "0", "13.4", "29", "58.6")
    assert x["Mean"] == "33.667" and x["Unique_Values"] == "-"
    assert (s["Class"], s["Missing"], s["Min"], s["Mean"], s["Unique_Values"]) == ("Categorical", "1", "-", "-", "3")
