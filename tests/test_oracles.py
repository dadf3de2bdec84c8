"""Every named query against its stated SQL on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, duck

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Series too short for any result at the smallest scale.
NEED_LARGER = {"dropped_gaps", "long_lags", "streamed_gap_sessions"}
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connections():
    return {sf: duck(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, connections, name):
    sf = LARGER if name in NEED_LARGER else SF
    message, _, ok = compare(spark, connections[sf], name, QUERIES[name], ORACLES[name], sf)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
