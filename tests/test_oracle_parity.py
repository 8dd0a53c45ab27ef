"""Every registered query with an oracle matches DuckDB (driver-style compare) at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SQL = E.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_is_registered():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    got = E.queries()[name](spark, sf_small).toPandas()
    want = con.execute(SQL[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg
