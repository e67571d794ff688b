"""Cutting a log into key-sorted runs.

A segment closes behind the first set that leaves at least `capacity` distinct keys, deletes counting as keys but never
closing. Where it closes depends on where it began, so exact cutting is one ordered pass; only (seq, key, tombstone)
take it, in one task with memory for `capacity` keys, and values join back by seq in parallel. Sharding by key hash cuts
each shard on its own: another segmentation, as parallel as there are shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.codec import stride
from tidelog.functions.ranges import quantiles, range_of
from tidelog.operators.resolve import newest


def assign_segments(log: DataFrame, capacity: int, shards: int = 1) -> DataFrame:
    """log with segment_id (from 1; shards > 1: also shard). The last segment of a shard may be the open memtable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, keys = None, 1, set()
        for b in batches:
            out = []
            for s, key, gone in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), b.column("tombstone").to_pylist(), strict=True):
                if s != shard:
                    shard, segment, keys = s, 1, set()
                out.append(segment)
                keys.add(key)
                if not gone and len(keys) >= capacity:
                    segment, keys = segment + 1, set()
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("shard"), pa.array(out, pa.int64())], ["seq", "shard", "segment_id"])

    shard = F.lit(0) if shards == 1 else F.expr(f"cast(pmod(xxhash64(key), {shards}) as int)")
    narrow = log.select("seq", "key", "tombstone", shard.alias("shard"))
    ordered = narrow.repartition(shards, "shard").sortWithinPartitions("shard", "seq")
    cut = ordered.mapInArrow(run, "seq long, shard int, segment_id long")
    out = log.join(cut, "seq")
    return out.drop("shard") if shards == 1 else out


def closed_segments(assigned: DataFrame, capacity: int) -> DataFrame:
    """(segment_id, closed): all but an open memtable end with a set that fills them."""
    keys = assigned.groupBy("segment_id", "key").agg(F.max("seq").alias("seq"), F.max_by("tombstone", "seq").alias("tombstone"))
    per = keys.groupBy("segment_id").agg(F.count("*").alias("n"), F.max_by("tombstone", "seq").alias("gone"))
    return per.select("segment_id", ((F.col("n") >= capacity) & ~F.col("gone")).alias("closed"))


def segment_entries(assigned: DataFrame, capacity: int) -> DataFrame:
    """(segment_id, key, value, tombstone) of flushed segments, tombstones kept."""
    entries = newest(assigned, keys=("segment_id", "key"))
    return entries.join(closed_segments(assigned, capacity).filter("closed"), "segment_id", "left_semi")


def memtable_residual(assigned: DataFrame, capacity: int) -> DataFrame:
    """(key, value, tombstone) of the writes behind the last flush."""
    entries = newest(assigned, keys=("segment_id", "key"))
    return entries.join(closed_segments(assigned, capacity).filter("not closed"), "segment_id", "left_semi").select("key", "value", "tombstone")


def bulk_segments(log: DataFrame, capacity: int, buckets: int = 256) -> DataFrame:
    """log with segment_id where keys are unique and all rows are sets: every `capacity` rows in seq order.

    Row numbers come from counts over at most `buckets` ranges of seq, of about as many rows each, and ranks within each,
    so no task sees the whole log.
    """
    placed = log.withColumn("bucket", range_of(F.col("seq"), quantiles(log, "seq", buckets)))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))  # at most `buckets` rows
    base = counts.withColumn("base", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).drop("n")
    ranked = placed.join(F.broadcast(base), "bucket").withColumn("row", F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("seq")) - 1)
    return ranked.withColumn("segment_id", F.expr(f"row div {capacity} + 1")).drop("bucket", "base", "row")


def segment_list(entries: DataFrame) -> DataFrame:
    """One row a segment, oldest first."""
    return (
        entries.groupBy("segment_id")
        .agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(F.col("tombstone").cast("long")).alias("tombstones"), F.sum(stride()).alias("bytes"))
        .orderBy("segment_id")
    )


def write_run(entries: DataFrame, path: str) -> None:
    """Segments one behind the other in key-sorted files, of which one may hold many, and many one; Bloom filters and min/max on key."""
    order = ["segment_id", "key"] if "segment_id" in entries.columns else ["key"]
    sorted_ = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.write.mode("append").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "100000").parquet(path)
