"""Operators whose whole result SQL can express, side by side with DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tessella.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, result.fetchall()))
