"""The driver's entry points."""

import __spark_entry__ as entry


def test_sql_is_given_for_known_queries_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    rows = entry.entry(spark)
    assert {"scanner", "kind", "tier", "leak_bound"} <= set(rows.columns) and rows.count() > 0
