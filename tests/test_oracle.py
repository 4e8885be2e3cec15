"""Every registered query against its checking SQL on the smallest tables."""

import pytest

from tests.compare import compare, connect
from yardframe.catalog import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.CHECKS))
def test_query_matches_sql(spark, connection, name):
    assert compare(registry.QUERIES[name](spark, FOLDER), connection, registry.CHECKS[name]) == []


def test_entry_gives_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
