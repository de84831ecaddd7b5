import pytest

from parity import DATA, assert_same

from ledgerloom.plans.oracle import SQL
from ledgerloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, str(DATA)), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
