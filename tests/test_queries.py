"""Every registered query against its SQL on DuckDB."""

import os
import re

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_all_have_sql():
    """All but those of the optional subpackage, of which few can be written in SQL."""
    optional = re.compile(r"op\d+_|pipeline$")
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert {n for n in contract.queries() if not optional.match(n)} <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, duck, name):
    found = difference(contract.queries()[name](spark, FOLDER), duck, contract.oracle_sql()[name])
    assert found is None, found


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_works_on_a_session_with_other_settings(spark, duck):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy")}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        for name in ("time_format", "merge_overlay", "tick_assign"):
            frame = contract.queries()[name](spark, FOLDER)
            assert difference(frame, duck, contract.oracle_sql()[name]) is None
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
