"""Every registered query against its SQL on the smallest data."""

import pytest

from tests.conftest import SF_DIR
from workload import ORACLES, QUERIES
from workload.check import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    if name in ORACLES:
        sql_names, expected = sql_rows(con, ORACLES[name])
        assert names == sql_names
        assert rows == expected
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 10
    assert set(contract.oracle_sql()) <= set(contract.queries())
