"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf, name):
    ok, message = check(spark, con, sf, name, entry.queries()[name], ORACLES[name])
    assert ok, message


def test_entry_has_one_row_per_column(spark):
    assert entry.entry(spark).count() == 11


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
