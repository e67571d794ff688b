"""The driver's contract."""

from __future__ import annotations

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "value"]
    assert df.count() == 12


def test_every_log_query_has_sql():
    from tidelog.plans import queries as log_queries

    assert set(log_queries.queries()) == set(log_queries.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
