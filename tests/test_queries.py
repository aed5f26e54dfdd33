"""Every registered evaluation query against its SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

from verdigris.plans import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    form = lambda v: "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(form(v[i]) for i in at) for v in values)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, sf, name):
    df = Q.queries()[name](spark, sf)
    rel = duck.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
