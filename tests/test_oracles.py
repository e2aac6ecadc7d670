"""Every query that has SQL gives exactly what another engine gives for it."""

import pytest

from compare import difference, oracle_connection, oracle_result, spark_result
from creditloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, folder, name):
    assert difference(spark_result(QUERIES[name](spark, folder)), oracle_result(con, ORACLES[name])) is None
