"""The registry: SQL for registered queries only, and columns of a sample of them."""

import __spark_entry__ as entry
from contactsheet.queries import QUERIES, SQL


def test_names():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
