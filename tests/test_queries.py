"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import sys

sys.path.insert(0, str(Path(__file__).parent))
import compare  # noqa: E402
import pytest

from fieldbook.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    ours, theirs = compare.both(QUERIES[name](spark, FOLDER), db, ORACLE_SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
