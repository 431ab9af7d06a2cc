"""Every query with SQL gives the rows of its SQL on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.parity import compare, connect

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(str(TABLES))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_sql(spark, con, name):
    assert compare(spark, con, str(TABLES), entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "item_id", "score", "rank"]
