"""Every registered query of the subpackage on the smallest data, against its DuckDB statement where it has one."""

import pytest

from strandlake.llm import registry
from tests.test_entry import connect, same


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_query(spark, data, db, name):
    assert same(registry.QUERIES[name](spark, data), db, registry.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, data, name):
    rows = registry.QUERIES[name](spark, data)
    assert rows.columns and rows.count() >= 0
