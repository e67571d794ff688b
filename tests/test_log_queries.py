"""Every query of the log engine against its SQL, over the first 3,000 events and whole other tables."""

from __future__ import annotations

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from conftest import SF, TABLES, compare, duck_at

from tidelog.plans import queries as log_queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Cutting the whole log is slow in SQL only: it rescans the rest once a segment."""
    root = tmp_path_factory.mktemp("tables")
    for t in TABLES:
        (root / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (root / "events.parquet").unlink()
    events = pq.read_table(f"{SF}/events.parquet")
    pq.write_table(events.filter(pc.field("event_id") < 3000), root / "events.parquet")
    return str(root)


@pytest.fixture(scope="module")
def con(folder):
    return duck_at(folder)


@pytest.mark.parametrize("name", sorted(log_queries.queries()))
def test_query_equals_sql(spark, folder, con, name):
    rows = compare(log_queries.queries()[name](spark, folder), con, log_queries.oracle_sql()[name])
    assert rows > 0 or name == "point_get"  # after these events that user is deleted
