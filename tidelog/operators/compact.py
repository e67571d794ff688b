"""Merging key-sorted runs, the newer side winning, tombstones kept unless the oldest run takes part and purging is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.resolve import newest


def merge_pair(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value, tombstone): full outer merge join of two runs."""
    a = old.select("key", F.struct("value", "tombstone").alias("a"))
    b = new.select("key", F.struct("value", "tombstone").alias("b"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("b", "a").alias("e")).select("key", "e.value", "e.tombstone")


def merge_runs(entries: DataFrame, purge: bool = False, by: str = "segment_id", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, value, tombstone, more) of any number of runs (segment_id, ...), highest segment_id, or other `by`, winning: one aggregation, not a chain of joins."""
    out = newest(entries, by, more=more)
    return out.filter("not tombstone") if purge else out


def compact(entries: DataFrame, rounds: int) -> DataFrame:
    """Entries after so many rounds, each merging the two oldest segments into the second's id: the first rounds + 1 become one."""
    ids = entries.select("segment_id").distinct()
    oldest = [r[0] for r in ids.orderBy("segment_id").limit(rounds + 1).collect()]  # as many ids as rounds asked for
    if len(oldest) < 2:
        return entries.select("segment_id", "key", "value", "tombstone")
    last = oldest[-1]
    merged = merge_runs(entries.filter(F.col("segment_id") <= last)).select(F.lit(last).cast("long").alias("segment_id"), "key", "value", "tombstone")
    return merged.unionByName(entries.filter(F.col("segment_id") > last).select("segment_id", "key", "value", "tombstone"))
