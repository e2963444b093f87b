"""The driver contract holds: names match, the flagship query runs."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
