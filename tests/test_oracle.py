"""Every registered query against its DuckDB statement (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from pagewright.plans import catalog
from tools.oracle_check import compare, duck

# Operators in folders of their own have their own tests.
QUERIES = {k: f for k, f in entry.queries().items() if k in catalog.QUERIES}
ORACLE = {k: s for k, s in entry.oracle_sql().items() if k in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    line, ok = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert ok, line


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc", "record"]
    assert df.count() > 0
