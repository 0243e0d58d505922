"""The queries that SQL can express, against DuckDB on the same files."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())
