"""Every registered query with SQL gives the SQL's rows; the others run and give rows."""

import pytest

import __spark_entry__ as driver
from oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    sql = driver.oracle_sql().get(name)
    function = driver.queries()[name]
    if sql is None:
        assert function(spark, SMALL).count() > 0
        return
    problem, _, _ = compare(spark, duck, function, sql, SMALL)
    assert problem is None


def test_entry_has_a_stable_schema(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["seq", "filename", "score"] and frame.count() > 0
