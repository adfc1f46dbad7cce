"""Every registered query against its SQL."""

import pytest
from conftest import SF
from oracle import connect, difference

import __spark_entry__
from lodgeframe import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name])[0] is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_all_are_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["prop_cd", "room_nights", "room_rev_usd"]
    assert df.count() > 0
