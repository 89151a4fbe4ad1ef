"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from ohmlake.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connected

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(AT)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    compare(QUERIES[name](spark, AT), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, AT).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
