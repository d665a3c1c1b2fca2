"""Every named query against its SQL on the smallest test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    ours = queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert difference(ours, duck.execute(SQL[name]).df()) is None
    else:
        assert len(ours)


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 28 and "roas" in df.columns
