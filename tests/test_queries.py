"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import waylens.case_queries
import waylens.queries
import waylens.reader_queries

PARTS = (waylens.queries, waylens.reader_queries, waylens.case_queries)
QUERIES = {k: v for m in PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in PARTS for k, v in m.ORACLE_SQL.items()}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
