"""Every registered query of the core against its DuckDB statement on the smallest data."""

import glob
import os

import duckdb
import pytest

from strandlake.plans import registry


def connect(folder):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rounded(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


def same(df, db, sql):
    rel = db.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    return rounded(df.collect()) == rounded([tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall()])


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_query(spark, data, db, name):
    assert same(registry.QUERIES[name](spark, data), db, registry.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
