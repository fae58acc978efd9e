from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_registered_query(spark, name):
    result, _ = compare(spark, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
