"""Row keys, hashes and dictionaries of a prepared table are made once."""

from pyspark.sql import functions as F

from loom.functions.rank import value_dictionary
from loom.operators import encode as EN
from loom.operators import sampling as SA
from loom.operators import scale as SC
from loom.sources.readers import add_row_key
from loom.workspace import Workspace


def test_keys_and_split_of_prepared_rows_are_those_of_the_raw_rows(spark):
    raw = spark.createDataFrame([(float(i % 7), "abc"[i % 3], float(i % 5)) for i in range(120)] + [(None, "a", 1.0)],
                                "x double, t string, y0 double")
    late = SC.scale(EN.encode(Workspace.from_df(raw), ["t"], "label"), ["x"], "minmax")
    late = late.evolve(add_row_key(late.df, "k", fields=list(late.raw)), key="k")
    early = SC.scale(EN.encode(Workspace.from_df(add_row_key(raw, "k"), key="k"), ["t"], "label"), ["x"], "minmax")
    got = [SA.split_workspace(SA.select_target(ws, "y0"), train=0.7) for ws in (late, early)]
    a, b = (sorted(map(tuple, ws.df.select("k", "x", "x__w", "t__w", "y", "split").collect())) for ws in got)
    assert a == b and len(a) == 120 and sum(r[-1] == "train" for r in a) == 84
    old = SA.holdout(got[0].df.drop("split"), "k", train=0.7).select("k", "split").collect()
    assert {tuple(r) for r in old} == {(r[0], r[-1]) for r in a}


def test_the_split_is_read_without_hashing_rows_again(spark):
    ws = Workspace.from_df(spark.range(50).withColumn("v", F.col("id") % 3).withColumn("w", F.col("id") % 4), key="id")
    ws = SA.split_workspace(SA.select_target(ws, "v"), train=0.6)
    assert "md5" not in ws.df._jdf.queryExecution().executedPlan().toString()
    assert ws.df.where("split = 'train'").count() == 30


def test_a_dictionary_does_not_read_its_table_again(spark, tmp_path):
    spark.range(40).select((F.col("id") % 6).cast("string").alias("s")).write.parquet(str(tmp_path / "t"))
    codes, n = value_dictionary(spark.read.parquet(str(tmp_path / "t")), "s")
    assert n == 6 and "parquet" not in codes._jdf.queryExecution().toString().lower()
    assert [r.code for r in codes.orderBy("s").collect()] == [1, 2, 3, 4, 5, 6]
