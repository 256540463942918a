"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, rows, _, _, notes = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert ok is not False, notes
    assert rows > 0 or name.startswith("alert_")


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
