import pytest
from oracle import assert_same
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_a_document_at_least(spark, sf_dir, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    got = {r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()}
    assert got <= docs if name.startswith("op1_") else got == docs
