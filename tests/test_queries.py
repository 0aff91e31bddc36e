import pytest

from plinth.plans import queries as plans
from tests.oracle import assert_same, duck

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    got = plans.QUERIES[name](spark, FOLDER)
    if name in plans.SQL:
        assert_same(got, con, plans.SQL[name])
    else:
        assert got.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
