"""Shared pieces of the training-data operators: scratch tables, size-checked broadcasts, byte-balanced batches."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.shared import shared_dir

#: A side is broadcast up to so many rows and bytes; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Texts handed to a library at once.
SLICE_BYTES = 4 << 20


class Scratch:
    """Tables of one run, as Parquet in the shared folder: a lost executor costs a re-read, not a re-run.

    Results may be read from them as long as the session lives; they go when it ends, or before by `forget`.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def save_owned(self, df: DataFrame, name: str, by: list[str], owners: int, order: str) -> DataFrame:
        """df in one file for each of so many owners, dealt by the hash of `by`: groups by those columns and others read it without a shuffle."""
        table = f"{os.path.basename(self.root)}_{name}".replace("-", "_")
        df.repartition(owners, *by).write.bucketBy(owners, *by).sortBy(order).option("path", f"{self.root}/{name}").format("parquet").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    @classmethod
    def forget(cls, kept: int) -> None:
        """Deletes all made since there were so many: nothing may be read from them any more."""
        for s in cls.made[kept:]:
            for t in s.tables:
                s.spark.sql(f"drop table if exists {t}")
            s.drop("")
        del cls.made[kept:]


def sized(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows and their bytes, counted now, are few; else as it is, so that the join shuffles."""
    weights = {"string": F.octet_length, "binary": F.octet_length, "array<string>": lambda c: F.octet_length(F.array_join(c, "", "")) + 16 * F.size(c)}
    size = sum((F.coalesce(weights[kind](F.col(c)), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in weights), F.lit(16 * len(df.columns)).cast("long"))
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and held <= most_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def joined(docs: list[bytes], pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in one array with pad zero bytes before each text, and each text's start and end there."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes + pad)
    gap = bytes(pad)
    data = np.frombuffer(b"".join(x for d in docs for x in (gap, d)) if pad else b"".join(docs), np.uint8)
    return data, ends - sizes, ends


def by_bytes(docs: Iterable[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most so many bytes together, or a single longer text."""
    first, held = 0, 0
    n = 0
    for n, d in enumerate(docs, 1):
        if held and held + len(d) > most:
            yield first, n - 1
            first, held = n - 1, 0
        held += len(d)
    if n > first:
        yield first, n


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema). A worker, which Spark reuses, first gives back what it holds of other work; keep: but for piece caches.

    Sets the session's bound on the bytes of an Arrow batch: a few very long texts can't blow up a worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            for cache in PieceCache.made:
                cache.clear()
        give_back()
        yield from run(batches)

    return df.mapInArrow(start, schema)


class PieceCache:
    """What a tokenizer gives for each piece of text that can be encoded alone, kept for the pieces seen last.

    Unseen pieces are encoded as one batch; when kept pieces exceed a bound, all go.
    """

    made: list[PieceCache] = []

    def __init__(self, encode: Callable[[list[bytes]], list], most_bytes: int = 24 << 20, most: int = 300_000):
        self.encode, self.most_bytes, self.most, self.held, self.bytes = encode, most_bytes, most, {}, 0
        self.made.append(self)

    def clear(self) -> None:
        self.held.clear()
        self.bytes = 0

    def __call__(self, pieces: list[list[bytes]]) -> Callable:
        held = self.held
        new = set()
        for p in pieces:
            new.update(filterfalse(held.__contains__, p))
        if new and (len(held) + len(new) > self.most or self.bytes > self.most_bytes):
            self.clear()
            new = {x for p in pieces for x in p}
        if new:
            ordered = list(new)
            held.update(zip(ordered, self.encode(ordered), strict=True))
            self.bytes += sum(map(len, ordered))
        return held.__getitem__


def cut(text: bytes, at: Callable[[bytes, int], int], most: int = SLICE_BYTES) -> Iterator[bytes]:
    """Slices of a long text; at(text, i) is the first safe boundary from i on, or -1."""
    begin = 0
    while len(text) - begin > most and (end := at(text, begin + most)) >= 0:
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text
