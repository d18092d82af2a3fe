"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
import oracle
from tidewire.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.load()[0]))
def test_query_equals_sql(spark, con, name):
    assert name in entry.oracle_sql()
    df = entry.queries()[name](spark, SF_DIR)
    assert oracle.difference(df, con, entry.oracle_sql()[name]) is None


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
