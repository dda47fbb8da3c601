"""Answers that once depended on the table's size, or were lost on the way through CSV."""

import pytest
from pyspark.sql import functions as F

from loom import session as S
from loom.functions.quantile import quantiles
from loom.functions.rank import value_dictionaries
from loom.functions.stats import distinct_counts, exceeds_distinct
from loom.operators import evaluate as V
from loom.operators import explore as E
from loom.operators.clean import impute
from loom.operators.convert import cat_to_num, num_to_cat, number_text
from loom.operators.encode import encode
from loom.operators.profile import summary
from loom.operators import sampling
from loom.operators.sampling import downsample, holdout, select_target, split_workspace, upsample
from loom.plans.inspect import physical_plan
from loom.sources.readers import add_row_key, load, read_csv
from loom.sources.writers import save_table_csv
from loom.workspace import Workspace


@pytest.mark.parametrize("max_levels", [100, 1])
def test_all_null_group_on_both_paths(spark, monkeypatch, max_levels):
    monkeypatch.setattr(S, "MAX_LEVELS", max_levels)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("c", 7.0), ("b", None)], "g string, x double")
    got = quantiles(df, "x", [0.5], by="g", names=["m"])
    assert sorted((r.g, r.m) for r in got.collect()) == [("a", 2.0), ("b", None), ("c", 7.0)]


def test_csv_keeps_quotes_commas_and_dates(spark, tmp_path):
    rows = [('say "hi", ok', "2024-01-01", 1), ("plain", "2024-02-03", None)]
    df = spark.createDataFrame(rows, "t string, d string, n int")
    path = str(tmp_path / "csv")
    save_table_csv(df, path)
    back = read_csv(spark, path)
    assert dict(back.dtypes)["d"] == "string"
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_csv_line_breaks(spark, tmp_path):
    (tmp_path / "f.csv").write_text('t,n\n"a\nb",1\n"c",2\n')
    got = read_csv(spark, str(tmp_path / "f.csv"), multiline=True)
    assert sorted((r.t, r.n) for r in got.collect()) == [("a\nb", 1), ("c", 2)]


def test_bigint_text_keeps_all_digits(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740992,)], "x long")
    assert sorted(r.t for r in df.select(number_text(df.x).alias("t")).collect()) == ["9007199254740992", "9007199254740993"]


def test_negative_binwidth_is_refused(spark):
    with pytest.raises(ValueError):
        E.histogram(spark.range(10).selectExpr("CAST(id AS double) AS x"), "x", binwidth=-5)


def test_diagonal_is_one_for_a_constant_column(spark):
    df = spark.range(10).selectExpr("CAST(id AS double) AS a", "1.0D AS b")
    got = {(r.x, r.y): r.r for r in E.corr_matrix(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): None}


def test_zero_binwidth_is_refused_and_a_tiny_one_is_not_broadcast(spark):
    df = spark.range(1000).selectExpr("CAST(id AS double) AS x")
    with pytest.raises(ValueError):
        E.histogram(df, "x", binwidth=0)
    assert "Broadcast" not in physical_plan(E.histogram(df, "x", binwidth=1e-6))


def test_restore_keeps_what_cleaning_filled(spark):
    ws = Workspace.from_df(spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None)], "k int, x int"))
    ws, done, failed = cat_to_num(impute(num_to_cat(ws, "x"), "x", "mode"), "x")
    assert (done, failed) == (["x"], [])
    assert {r.k: r.x for r in ws.display().collect()} == {1: 5, 2: 5, 3: 7, 4: 5}


def test_mode_of_a_label_encoded_column(spark):
    ws = Workspace.from_df(spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (4, None)], "k int, s string"))
    ws = impute(encode(ws, "s", "label"), "s", "mode")
    raw = {r.k: r.s for r in ws.display().collect()}
    work = {r.k: r.s for r in ws.working().collect()}
    assert raw[4] == "b" and work[4] == work[1] != work[3]


def test_one_hot_names_are_unique(spark):
    df = spark.createDataFrame([("a b", 1), ("a_b", 2), ("c", 3)], "s string, s_c int")
    got = encode(Workspace.from_df(df), "s", "onehot").working()
    assert sorted(got.columns) == ["s_a_b", "s_a_b_2", "s_c", "s_c_2"]
    assert [r.s_c_2 for r in got.orderBy("s_c").collect()] == [0.0, 0.0, 1.0]


def test_features_may_be_called_y_y_label_and_split(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i), float(-i), f"s{i % 2}") for i in range(40)],
                               "k int, x double, y double, y_label double, split string")
    ws = select_target(Workspace.from_df(df, "k"), "x")
    assert (ws.y, ws.y_label) == ("y_2", "y_label_2")
    got = split_workspace(ws, 0.7)
    assert got.split == "split_2"
    rows = {r.k: r for r in got.df.collect()}
    for k, x, y, y_label, split in df.collect():
        assert (rows[k].y_2, rows[k].y_label_2, rows[k].y, rows[k].y_label, rows[k].split) == (x, x, y, y_label, split)
    assert sum(r.split_2 == "train" for r in rows.values()) == 28
    assert set(got.working().columns) >= {"y", "y_label", "split", "y_2", "y_label_2"}
    with pytest.raises(ValueError, match="already"):
        holdout(df, "k", 0.7)
    # a target of that name, without a clash, keeps it
    assert sorted(r.y for r in select_target(Workspace.from_df(df.select("x", "y")), "y").df.collect()) == [
        float(i) for i in range(40)]


def test_decimals_stay_apart_as_categories(spark):
    df = spark.sql("SELECT CAST(v AS decimal(20, 1)) AS d FROM VALUES ('90071992547409930.1'), ('90071992547409930.2'), "
                   "('5.0'), ('100.0'), ('-0.5') AS t(v)")
    got = num_to_cat(Workspace.from_df(df), ["d"]).working()
    assert sorted(r.d for r in got.collect()) == ["-0.5", "100", "5", "90071992547409930.1", "90071992547409930.2"]


def test_load_reads_line_breaks_and_refuses_ragged_rows(spark, tmp_path):
    rows = [("one\ntwo, three", 1), ("plain", 2), (None, 3)]
    path = str(tmp_path / "t.csv")
    save_table_csv(spark.createDataFrame(rows, "t string, n int"), path)
    assert sorted(map(tuple, load(spark, path, multiline=True).collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    for name in ("long", "short"):
        with pytest.raises(Exception, match="(?i)malformed"):
            load(spark, str(tmp_path / f"{name}.csv")).select("a").collect()
    fill = load(spark, str(tmp_path / "short.csv"), ragged="fill")
    assert sorted(map(tuple, fill.collect()), key=str) == [(1, 2), (3, None)]


def test_distinct_screen_is_exact(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"), "id",
                                  F.when(F.col("id") % 11 < 10, F.col("id") % 11).alias("ten_and_null"),
                                  F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zero"),
                                  F.lit(None).cast("int").alias("none"))
    assert exceeds_distinct(df, df.columns, 10) == {
        "ten": False, "eleven": True, "id": True, "ten_and_null": True, "zero": False, "none": False}
    assert exceeds_distinct(df.limit(0), df.columns, 10) == dict.fromkeys(df.columns, False)
    assert {c: n > 10 for c, n in distinct_counts(df, df.columns).items()} == exceeds_distinct(df, df.columns, 10)


def test_dictionaries_of_many_columns_at_once(spark, monkeypatch):
    df = spark.range(300).select(
        (F.col("id") % 7).alias("i"), (F.col("id") % 5 / 4 - 0.5).alias("d"), (F.col("id") % 13).cast("string").alias("s"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("b"), F.expr("date_add(DATE'2020-01-30', int(id % 4))").alias("t"),
        (F.col("id") % 6).cast("decimal(9, 2)").alias("dec"), F.lit(None).cast("string").alias("none"))
    want = {c: sorted({r[0] for r in df.select(c).collect()} - {None}) for c in df.columns}
    for bound in (200_000, 10):
        monkeypatch.setattr(S, "BROADCAST_ROWS", bound)
        found = value_dictionaries(df, df.columns)
        for c in df.columns:
            rows = sorted(found[c][0].collect(), key=lambda r: r["__code"])
            assert [r[0] for r in rows] == want[c] and [r[1] for r in rows] == list(range(1, len(want[c]) + 1))
            assert found[c][1] == len(want[c])


def classes(spark):
    rows = [(i, "big" if i < 900 else "mid" if i < 1100 else "few" if i < 1105 else None) for i in range(1110)]
    return spark.createDataFrame(rows, "k int, c string").repartition(4)


def test_undersampling_by_thresholds_and_by_ranks(spark, monkeypatch):
    few = sorted(map(tuple, downsample(classes(spark), "c", "k").collect()), key=str)
    assert {c: sum(r[1] == c for r in few) for c in ("big", "mid", "few", None)} == dict.fromkeys(("big", "mid", "few", None), 5)
    for module, name, value in ((sampling, "FEW_CLASSES", 0), (S, "MAX_LEVELS", 2)):      # joined thresholds, then ranks
        monkeypatch.setattr(module, name, value)
        assert sorted(map(tuple, downsample(classes(spark), "c", "k").collect()), key=str) == few


def test_oversampling_draws_alike_with_and_without_broadcast(spark, monkeypatch):
    got = sorted(map(tuple, upsample(classes(spark), "c", "k").collect()), key=str)
    assert {c: sum(r[1] == c for r in got) for c in ("big", "mid", "few")} == dict.fromkeys(("big", "mid", "few"), 900)
    monkeypatch.setattr(sampling, "TINY", 0)
    assert sorted(map(tuple, upsample(classes(spark), "c", "k").collect()), key=str) == got


def test_decimals_beyond_double_are_distinct(spark):
    df = spark.sql("SELECT CAST(v AS decimal(20, 1)) AS d FROM VALUES ('9007199254740993.1'), ('9007199254740993.2') AS t(v)")
    assert distinct_counts(df, ["d"]) == {"d": 2}


def test_formatted_summary_keeps_fifteen_digits(spark):
    row = summary(spark.createDataFrame([(123456789.5,), (5.0,), (0.25,)], "x double"), formatted=True).first()
    assert (row.Max, row.Median, row.Min) == ("123456789.5", "5", "0.25")


def test_row_key_tells_microseconds_apart(spark):
    df = spark.sql("SELECT timestamp_micros(id * 100) AS t, timestamp_ntz '2024-01-01 00:00:00' AS u FROM range(2)")
    assert add_row_key(df).select("row_id").distinct().count() == 2


def test_profiles_only_for_two_text_columns(spark):
    df = spark.createDataFrame([("a", 1, "u"), ("b", 2, "v")], "s string, n int, t string")
    assert "column_profiles" not in E.relate(df, "s", "n")
    assert "column_profiles" in E.relate(df, "s", "t")


def test_roc_direction(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.3), (0, 0.2), (0, 0.9), (0, 0.8)], "actual int, score double")
    up, auto = V.auc(df).first().auc, V.auc(df, direction="auto").first().auc
    assert auto == pytest.approx(1 - up) and auto == pytest.approx(5 / 6)
    assert V.auc(df.withColumn("score", -F.col("score")), direction="auto").first().auc == pytest.approx(auto)
    per = V.auc_per_class(df.withColumn("s2", -F.col("score")), "actual", {1: "score", 0: "s2"}, direction="auto")
    assert [r.auc for r in per.collect()] == pytest.approx([auto, auto])
    points = V.roc_curve(df, direction="auto").orderBy("fpr", "tpr").collect()
    assert points[0].threshold == float("-inf") and points[1].threshold == 0.1
    with pytest.raises(ValueError):
        V.auc(df, direction="down")


@pytest.mark.parametrize("max_levels", [100, 1])
def test_quantiles_with_infinities_and_default_names_on_both_paths(spark, monkeypatch, max_levels):
    monkeypatch.setattr(S, "MAX_LEVELS", max_levels)
    inf = float("inf")
    rows = [("a", float(i)) for i in range(50)] + [("a", inf), ("b", -inf), ("b", -inf), ("b", 3.0), ("c", inf), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {"a": (12.5, 25.0), "b": (-inf, -inf), "c": (inf, inf), "d": (None, None)}
    got = quantiles(df, "x", [0.25, 0.5], by="g", leaf_rows=8, bits=4)
    assert {r["g"]: (r["q0.25"], r["q0.5"]) for r in got.collect()} == want
    assert quantiles(df, "x", [0.5], leaf_rows=8, bits=4).first()[0] == 24.0


def test_quantiles_of_log_spread_values(spark):
    df = spark.range(-60, 60).selectExpr("pow(10D, id) AS x")
    assert quantiles(df, "x", [0.1], leaf_rows=4, bits=4).first()[0] == pytest.approx(
        df.agg(F.percentile("x", 0.1)).first()[0])
