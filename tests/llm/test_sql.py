"""Corpus queries next to their SQL on the smallest given tables; the others run and keep every document."""

from __future__ import annotations

import pytest
from compare import compare, connect

from bazaarflow.llm import oracle, queries

SF_DIR = "/root/testdata/sf0.001"
STATEMENTS = oracle.all_statements()


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, con, name):
    ok, detail = compare(con, queries.all_queries()[name](spark, SF_DIR), STATEMENTS[name])
    assert ok, detail


@pytest.mark.parametrize("name", sorted(set(queries.all_queries()) - set(STATEMENTS) - {"op6_ann_search"}))
def test_keeps_every_document(spark, con, name):
    found = [r.doc_id for r in queries.all_queries()[name](spark, SF_DIR).select("doc_id").collect()]
    assert sorted(found) == sorted(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())


def test_pipeline_stages_hand_documents_on(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids is None or now <= ids, name
        ids = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.filter("not round_trip").isEmpty() and ids
