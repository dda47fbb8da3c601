"""Registered text queries against their SQL, and the pipeline's stages end to end."""

import pytest
from oracle import compare, duck

import corpus_pipeline
from __spark_entry__ import queries
from loom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_sql(spark, name):
    ok, msg = compare(spark, name, SMALL, Q.QUERIES, Q.ORACLE, con=duck(SMALL))
    assert ok, msg


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got.doc_id.is_unique and 0 < len(got) < docs.count()
    assert (got.taken <= 3 * got["size"]).all() and abs(got.taken.sum() - got["size"].sum()) <= 20
    found = Q.op1_decontamination(spark, SMALL).filter("contaminated").toPandas()
    assert not set(found.doc_id) & set(got.doc_id)
