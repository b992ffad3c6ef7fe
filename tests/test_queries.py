"""Every registered query against its SQL, over the whole smallest tables."""
import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, FOLDER, name, entry.queries()[name],
                       entry.oracle_sql().get(name))
    assert ok, note


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.count() == 5 and "value" in frame.columns
