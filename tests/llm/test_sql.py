"""Corpus queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from lattica.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLES[name]}) q").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.select(*columns).collect()) and want
