"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest

from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare.compare(spark, con, name, SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 3
