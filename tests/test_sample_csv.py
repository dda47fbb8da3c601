"""Golden values on the sample employee-salary CSV described in FIXTURES.md section 1.

Point ``LOOM_SAMPLE_CSV`` at the file; the test is skipped when it is not set.
"""

import os

import pytest
from pyspark.sql import functions as F

from loom.functions.quantile import quantile_values
from loom.operators import clean as CL
from loom.operators import encode as EN
from loom.operators import explore as EX
from loom.operators import models as M
from loom.operators import profile as P
from loom.operators import sampling as SA
from loom.sources import add_row_key, load
from loom.workspace import Workspace

CSV = os.environ.get("LOOM_SAMPLE_CSV", "")
pytestmark = pytest.mark.skipif(not CSV or not os.path.exists(CSV), reason="LOOM_SAMPLE_CSV not set")


@pytest.fixture(scope="module")
def emp(spark):
    return load(spark, CSV)


def test_shape_and_missing(emp):
    assert emp.count() == 375 and len(emp.columns) == 6
    assert emp.columns[0] == "Age"
    s = {r["column"]: r for r in P.summary(emp).collect()}
    assert all(s[c]["missing"] == 2 for c in emp.columns)
    assert s["Salary"]["median"] == 95000 and s["Age"]["min"] == 23 and s["Age"]["max"] == 53
    assert s["Salary"]["sd"] == pytest.approx(48240.013, abs=1e-3)
    assert s["Years of Experience"]["variance"] == pytest.approx(42.994, abs=1e-3)
    assert s["Gender"]["unique_values"] == 3  # Male, Female and NA counted as a value
    assert P.missing_percent(emp, "Age").first()[0] == 0.53


def test_blank_strings_as_category(spark):
    df = load(spark, CSV, blank_strings="category")
    counts = {r["level"]: r["count"] for r in P.target_distribution(df, "Gender").collect()}
    assert counts[""] == 2 and counts["Male"] == 194
    assert EX.correlation_ratio(df, "Gender", "Salary").first()["eta"] is None


def test_quartiles_fences_mode(emp):
    assert quantile_values(emp, "Salary", [0.25, 0.75]) == [55000, 140000]
    b = CL.iqr_bounds(emp, "Age")
    assert (b["lower"], b["upper"]) == (11.5, 63.5)
    assert CL.outlier_count(emp, "Salary").first()[0] == 0
    assert CL.mode_value(emp, "Age") == 33 and CL.mode_value(emp, "Years of Experience") == 2


def test_bivariate_goldens(emp):
    r = {(x["x"], x["y"]): x["r"] for x in EX.corr_matrix(emp, digits=6).collect()}
    assert r[("Age", "Years of Experience")] == pytest.approx(0.979128, abs=1e-6)
    assert r[("Age", "Salary")] == pytest.approx(0.922335, abs=1e-6)
    assert EX.correlation_ratio(emp, "Gender", "Salary", digits=6).first()[0] == pytest.approx(0.070916, abs=1e-6)
    assert EX.correlation_ratio(emp, "Education Level", "Salary", digits=6).first()[0] == pytest.approx(0.678161, abs=1e-6)
    ct = {(r["Gender"], r["Education Level"]): r["count"] for r in EX.contingency(emp, "Gender", "Education Level").collect()}
    assert ct[("Female", "Bachelor's")] == 103 and ct[("Male", "PhD")] == 25
    assert EX.cramers_v(emp, "Gender", "Education Level", digits=6).first()[0] == pytest.approx(0.049260, abs=1e-6)
    hist = [r["count"] for r in EX.histogram(emp, "Salary").orderBy("bin").collect()]
    assert hist == [1, 85, 49, 76, 47, 49, 36, 27, 1, 2]


def test_label_codes_and_ols(emp):
    ws = EN.encode(Workspace.from_df(add_row_key(emp), "row_id"), ["Education Level"], "label")
    codes = dict(ws.df.select("Education Level", ws.wcol("Education Level")).distinct().dropna().collect())
    assert codes == {"Bachelor's": 1, "Master's": 2, "PhD": 3}
    complete = CL.na_omit(emp)
    assert complete.count() == 373
    fm = M.train(complete, "linear_regression", ["Age", "Years of Experience"], label="Salary")
    lr = fm.pipeline.stages[-1]
    assert lr.intercept == pytest.approx(-18700.4068, abs=1e-3)
    assert list(lr.coefficients) == pytest.approx([1885.8292, 4853.8434], abs=1e-3)


def test_row_key_stable_and_holdout_size(spark, emp):
    a = {r[0] for r in add_row_key(emp).select("row_id").collect()}
    b = {r[0] for r in add_row_key(emp.repartition(7)).select("row_id").collect()}
    assert a == b and len(a) == 375
    complete = add_row_key(CL.na_omit(emp))
    split = SA.holdout(complete, "row_id", 0.7, seed=123)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 261, "test": 112}


def test_save_training_roundtrip(spark, emp, tmp_path):
    from loom.sources import save_training
    ws = Workspace.from_df(add_row_key(emp), "row_id").submit()
    path = str(tmp_path / "train.csv")
    save_training(ws, path)
    back = spark.read.options(header=True, nullValue="NA", inferSchema=True).csv(path)
    assert back.count() == 375
    assert back.where(F.col("Salary").isNull()).count() == 2
