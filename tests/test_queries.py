"""Every registered query runs on the smallest tables and agrees with its SQL."""

import pytest

import __spark_entry__ as entry
import check


@pytest.fixture(scope="module")
def con(sf):
    return check.database(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf, name):
    verdict, _ = check.compare(spark, con, name, sf)
    assert verdict.startswith(("ok", "rows")), verdict


def test_entry(spark):
    assert entry.entry(spark).columns == ["column_name", "outliers"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
