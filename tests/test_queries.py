"""Every query with SQL against DuckDB on the smallest data, where it is there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import difference

ROOT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, entry.queries()[name], entry.oracle_sql()[name], str(ROOT)) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, str(ROOT))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
