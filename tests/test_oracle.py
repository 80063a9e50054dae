"""Every registered query beside its DuckDB check, at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check
from textorbit import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"]
    assert df.count() == 40 * 5


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
