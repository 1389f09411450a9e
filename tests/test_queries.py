"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quire.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        order = [want.columns.index(c) for c in cols]
        assert sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()) == got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
