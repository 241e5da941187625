"""Every registered query against its oracle SQL on the smallest tables."""

import pytest
from compare import difference

import __spark_entry__ as entry
import registry

# The optional subpackage's queries have tests of their own beside its other tests.
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    if name in ORACLES:
        assert difference(spark, duck, QUERIES[name], ORACLES[name], sf) is None
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
