"""The queries of this subpackage against their SQL and brute force, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from shelfmark.llm import registry
from shelfmark.llm.common import table, written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_pipeline_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[3] == counts[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
