"""Every query that has SQL gives DuckDB's rows on the smallest scale factor."""

import math

import duckdb
import pytest

from lattica.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.ORACLES[name]}) q").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    key = lambda r: tuple((x is None, str(x) if not isinstance(x, (int, float)) else 0, x if isinstance(x, (int, float)) and x is not None else 0) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want) > 0
    bad = [(a, b) for a, b in zip(rows, want, strict=True) if not all(map(close, a, b))]
    assert not bad, (columns, bad[:5], len(bad))
