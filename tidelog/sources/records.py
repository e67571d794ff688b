"""Raw record files (`segment-<id>.dat`, log files) as a Spark data source, format name `tidelog.records`.

Options: path (a file, a folder or a glob; or `paths`, separated by line ends), mode: permissive (default: a torn or unknown record ends its file)
or failfast. An equality filter on key is applied while decoding. Files must be reachable from executors by a file path,
as raw files of the format are; tables kept by this library are Parquet. Write one file a task with format(...).save(folder).
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidelog.functions.codec import pack_record, segment_name
from tidelog.functions.codec import read_records as decode_file

SCHEMA = "segment_id bigint, key string, value string, tombstone boolean, offset bigint"
_ID = re.compile(r"^segment-([0-9]+)\.dat$")


def files_at(path: str) -> list[str]:
    """Segment files by number, 10 behind 2; a single file, whatever its name; other files of a folder aren't segments."""
    out = []
    for p in glob.glob(path) or [path]:
        own = [os.path.join(p, x) for x in os.listdir(p) if _ID.match(x)] if os.path.isdir(p) else [p]
        out += own
    return sorted(out, key=lambda p: (int(m[1]) if (m := _ID.match(os.path.basename(p))) else -1, p))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = files_at(options["path"]) if "path" in options else options["paths"].split("\n")
        self.strict = options.get("mode", "permissive").lower() == "failfast"
        self.key: str | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.key = f.value
            yield f  # Spark checks it again

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        m = _ID.match(os.path.basename(partition.value))
        with open(partition.value, "rb") as f:
            for key, value, gone, offset in decode_file(f, os.fstat(f.fileno()).st_size, self.strict):
                if self.key is None or key == self.key:
                    yield int(m[1]) if m else None, key, value, gone, offset


class _Done(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        """Rows (segment_id, key, value, tombstone), a segment's together and in key order; each file is made aside and then renamed."""
        os.makedirs(self.folder, exist_ok=True)
        paths, out, now = [], None, None
        try:
            for r in iterator:
                if r.segment_id != now:
                    if out:
                        out.close()
                    now = r.segment_id
                    paths.append(os.path.join(self.folder, segment_name(now)))
                    out = open(f"{paths[-1]}.new", "wb")
                out.write(pack_record(r.key, None if r.tombstone else r.value))
        finally:
            if out:
                out.close()
        return _Done(paths)

    def commit(self, messages) -> None:
        for m in messages:
            for p in m.paths if m else []:
                os.replace(f"{p}.new", p)

    def abort(self, messages) -> None:
        for m in messages:
            for p in m.paths if m else []:
                if os.path.exists(f"{p}.new"):
                    os.remove(f"{p}.new")


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog.records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def read_records(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    register(spark)
    return spark.read.format("tidelog.records").option("mode", mode).load(path)


def write_records(entries: DataFrame, folder: str) -> None:
    """One raw file a segment, key-sorted."""
    register(entries.sparkSession)
    rows = entries.select("segment_id", "key", "value", "tombstone")
    rows.repartition("segment_id").sortWithinPartitions("segment_id", "key").write.format("tidelog.records").mode("append").save(folder)
