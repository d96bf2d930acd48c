"""Every registered rule query against its SQL."""

import pytest
from compare import difference, views

from tidewatch.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf):
    return views(sf)


def test_each_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, connection, name):
    assert difference(QUERIES[name](spark, sf), ORACLES[name], connection) == ""
