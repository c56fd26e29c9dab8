"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
import check

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return check.database(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, sf, name):
    assert check.difference(spark, db, sf, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.count() > 0 and "attainment" in got.columns
