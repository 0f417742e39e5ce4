"""Every core query that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from orrery.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()) == ""


@pytest.mark.parametrize("name", ["c3_linkage", "c5_cut", "c7_spectral"])
def test_without_sql_gives_rows(spark, name):
    """What the rows are is tested in test_whole_tables and test_operators."""
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["task_idx", "place_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
