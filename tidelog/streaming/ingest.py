"""Logs as streams. Order is by seq, not arrival, in memory and in a store, so late rows are harmless and no watermark is needed; state is a row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.resolve import newest
from tidelog.plans.store import Engine
from tidelog.schemas import OP_LOG


def read_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(OP_LOG.replace(" not null", "")).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def live_stream(log: DataFrame) -> DataFrame:
    """Newest-wins state of a streaming log, for output mode complete or update; tombstones are rows, so that a sink sees deletes."""
    return newest(log)


def ingest(log: DataFrame, engine: Engine, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a store, which flushes as it fills; one compaction step a batch where it is due.

    The manifest holds the last batch of each checkpoint, so one that is run again after a failure counts once. The log's
    own seq decides, whatever the order in which rows and files arrive.
    """
    import time

    def each(batch: DataFrame, number: int) -> None:
        engine.store.append(batch.select("seq", "key", "value", "tombstone"), checkpoint, number)
        engine.tick(time.monotonic())

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
