"""Every registered query with SQL gives DuckDB's rows on whole tables."""

import pytest

import __spark_entry__
from tests.conftest import DATA
from tests.oracle import assert_same, connect

SF = f"{DATA}/sf0.01"
QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["status"] == "pass"
