"""Registered corpus queries on the smallest tables: against SQL where there is some, else their shape and totals."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from veilgate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("pages", "documents", "conversations", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_input_row(spark, name):
    got = QUERIES[name](spark, SF)
    key, table = next((k, t) for k, t in (("page_id", "pages"), ("vec_id", "embeddings"), ("doc_id", "documents")) if k in got.columns)
    rows = got.collect()
    if "component" in got.columns:  # a row per vector and component
        assert {r.component for r in rows} == set(range(1, 33)) and {r.identity_error < 1e-4 for r in rows} == {True}
        rows = [r for r in rows if r.component == 1]
    assert sorted(r[key] for r in rows) == [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).orderBy(key).collect()]
    if "decoded_sha256" in got.columns:
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
