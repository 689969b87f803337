"""Every registered query against its SQL, or for rows where SQL cannot state it."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_keys_line_up():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, key):
    ok, message = compare(spark, con, key, entry.queries()[key], SQL[key], sf_dir)
    assert ok, message
