"""Every query with an SQL counterpart gives the same rows as that SQL."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

# Model fits take long and are covered in test_models.
SLOW = {"bundle_roundtrip", "stream_score"}
NAMES = sorted(n for n in entry.oracle_sql() if n not in SLOW or os.environ.get("TEST_ALL"))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000
    assert {"event_id", "score", "verdict", "reason_codes"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
