"""Sparse index, byte ranges and bounded lookups.

Windows are per segment, whose size the memtable's capacity bounds. A segment that compaction made has no such bound: its
offsets are counted in ranges of keys, of about as many entries each.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.config import SPARSE_STRIDE
from tidelog.functions.codec import stride
from tidelog.functions.ranges import quantiles, range_of


def _ranged(entries: DataFrame, ranges: int) -> DataFrame:
    """entries with range: keys cut into ranges by the seven bytes behind what all keys begin with."""
    if ranges < 2:
        return entries.withColumn("range", F.lit(0).cast("long"))
    low, high = entries.agg(F.min("key"), F.max("key")).first()
    skip = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    head = F.rpad(F.hex(F.substring(F.col("key").cast("binary"), skip + 1, 7)), 14, "0")
    held = entries.withColumn("range", F.conv(head, 16, 10).cast("long"))
    return held.withColumn("range", range_of(F.col("range"), quantiles(held, "range", ranges)))


def entry_offsets(entries: DataFrame, ranges: int = 1) -> DataFrame:
    """entries with idx, stride and byte offset in their segment's file. ranges: of keys in a large segment, counted apart."""
    held = _ranged(entries.withColumn("stride", stride()), ranges)
    w = Window.partitionBy("segment_id", "range").orderBy("key")
    own = held.withColumn("offset", F.sum("stride").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("stride")).withColumn("idx", F.row_number().over(w).cast("long") - 1)
    if ranges < 2:
        return own.drop("range")
    before = Window.partitionBy("segment_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("segment_id", "range").agg(F.count("*").alias("n"), F.sum("stride").alias("size"))
    base = sums.select("segment_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size"))
    placed = own.join(base, ["segment_id", "range"])
    return placed.withColumn("idx", F.col("idx") + F.col("n")).withColumn("offset", F.col("offset") + F.col("size")).drop("range", "n", "size")


def sparse_index(entries: DataFrame, every: int = SPARSE_STRIDE, ranges: int = 1) -> DataFrame:
    """(segment_id, key, offset) of every so-manieth entry."""
    return entry_offsets(entries, ranges).filter(F.col("idx") % every == 0).select("segment_id", "key", "offset")


def byte_range(index: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (segment_id, key) with start: the offset of the greatest indexed key up to theirs, and end: of the least one beyond; null where there is none.

    One merge by (segment_id, key) of both sides, not a range join.
    """
    both = index.select("segment_id", "key", "offset", F.lit(0).alias("kind")).unionByName(probes.select("segment_id", "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("kind")))
    w = Window.partitionBy("segment_id").orderBy("key", "kind")
    start = F.last("offset", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.first("offset", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return both.select("segment_id", "key", "kind", start.alias("start"), end.alias("end")).filter("kind = 1").drop("kind")


def bounded_lookup(entries: DataFrame, index: DataFrame, probes: DataFrame) -> DataFrame:
    """probes with what their segment holds for the key within its byte range: state and value."""
    ranges = byte_range(index, probes)
    held = entry_offsets(entries).select("segment_id", "key", "value", "tombstone", "offset")
    inside = (F.col("offset") >= F.coalesce("start", F.lit(0))) & (F.col("end").isNull() | (F.col("offset") < F.col("end")))
    found = ranges.join(held, ["segment_id", "key"], "left").withColumn("hit", F.coalesce(inside, F.lit(False)))
    state = F.when(~F.col("hit"), "absent").when(F.col("tombstone"), "tombstone").otherwise("value")
    return found.select("segment_id", "key", state.alias("state"), F.when(F.col("hit"), F.col("value")).alias("value"))


def segment_inspect(index: DataFrame, segment_id: int) -> DataFrame:
    return index.filter(F.col("segment_id") == segment_id).select("key", "offset").orderBy("key")
