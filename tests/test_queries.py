"""Every query with an SQL twin gives the twin's rows on the smallest data; the others run."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.count() >= 0


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
