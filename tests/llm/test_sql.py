"""Queries with SQL agree with it on the smallest tables; the others run and keep their columns."""

import duckdb
import pytest

from quillspark.llm import queries, sql

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["arxiv_id", "field", "record_id"],
    "p2_found": ["name_a", "name_b"],
    "p3_found": ["arxiv_id", "rec_id"],
    "p4_found": ["arxiv_id_a", "arxiv_id_b"],
    "p5_found": ["arxiv_id_a", "arxiv_id_b"],
    "p6_found": ["record_id", "venue_id"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW papers AS SELECT * FROM '{SF}/papers.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(sql.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(want.select(*order).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.count() > 0 and got.columns == COLUMNS.get(name, got.columns)
