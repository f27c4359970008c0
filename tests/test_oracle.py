"""Every named query against its SQL."""

import pytest
from support import SF_DIR

import __spark_entry__ as entry
import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, name, SF_DIR) is None
