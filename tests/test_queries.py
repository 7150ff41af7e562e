"""Every query that SQL can express, side by side with DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tessella.plans import flows, rows, rules, whereabouts  # noqa: F401  (they add their queries to the catalogue)
from tessella.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v) -> str:
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert sorted(names) == cols
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["microdata_postings", "companies_shown", "display_names"])
def test_rows_of_one_file_are_dealt(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pages_reach_python_in_small_batches(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for given, used in (("10000", "2000"), ("300", "300")):
            spark.conf.set(key, given)
            assert QUERIES["html_text"](spark, sf_dir).count() > 0 and spark.conf.get(key) == used
    finally:
        spark.conf.set(key, was)


def test_every_location_is_counted(spark, tmp_path):
    """Of rows with very many places all count, and long ones that begin alike are two."""
    many, long = " ".join(f"p{k}" for k in range(450)), "x" * 300
    rows = [(i, 1, "assistant", f"{many} {' '.join(f'{i}-{k}' for k in range(300))} last") for i in range(3)] + [(3, 0, "user", f"{long}y. {long}z, P7")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["location_counts"](spark, str(tmp_path)).collect()]
    assert got == c.execute(ORACLE_SQL["location_counts"]).fetchall() and {("last", 3), ("p449", 3)} <= set(got)
