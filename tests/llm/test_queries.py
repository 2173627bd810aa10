"""The registered queries over the smallest tables, against their SQL where they have one."""

import pytest

import corpus_pipeline
from tercet.llm import queries
from tests.test_oracles import DIR, con, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):  # noqa: F811
    df, want = queries.queries()[name](spark, DIR), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op2_toxicity", "documents"), ("op3_html_extraction", "pages"), ("op4_lm_scoring", "documents"), ("op6_pii", "documents"), ("op7_quality", "documents"), ("op8_mixing", "documents")])
def test_every_row_is_there(spark, name, table):
    assert queries.queries()[name](spark, DIR).count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


def test_every_hundredth_vector_is_a_query(spark):
    got = queries.queries()["op5_nearest_neighbours"](spark, DIR)
    assert {r[0] for r in got.select("vec_id").distinct().collect()} == {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}


def test_pipeline_runs(spark):
    out = corpus_pipeline.queries()["pipeline"](spark, DIR)
    assert out.columns == [*spark.read.parquet(f"{DIR}/documents.parquet").columns, "copies"] and out.count() > 0
