"""A store: an append-only log, key-sorted segments, and a manifest that says which of both count.

The segments that a flush makes are one run: files that hold one segment behind another, so that neither paths nor the
manifest grow with the segments but with the flushes. Compaction makes one base of the oldest segments. Every entry has
its seq, and the greatest seq of a key decides, wherever it lies: rows that arrive late lose to newer ones. A get reads
the runs whose range of keys holds the key, by a filter that Parquet's Bloom filters answer.

A commit writes new files, then a new manifest by an atomic rename, and only then may old files go, those of the commit
before: a crash at any point leaves the store as it was before or after, and a reader that began with the last manifest
finds its files. Manifests are numbered; the highest counts. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import Config
from tidelog.errors import NotFound, TidelogError, TooLarge
from tidelog.functions.codec import MOST, too_large
from tidelog.operators.compact import merge_runs
from tidelog.operators.index import segment_inspect, sparse_index
from tidelog.operators.resolve import batch_get, list_keys, live, newest
from tidelog.operators.segment import assign_segments, closed_segments, write_run
from tidelog.operators.segment import segment_list as list_of
from tidelog.schemas import OP_LOG, REQUEST

_MANIFEST = re.compile(r"^manifest-([0-9]+)\.json$")
_ENTRY = "segment_id bigint, seq bigint, key string, value string, tombstone boolean"
#: Characters of a key that the manifest keeps.
_KEPT = 64


class Files:
    """What the manifest needs of a file system, through Hadoop's: any that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(root))

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file or none, and none where one is there: a rename that does not overwrite, atomic where the file system's is."""
        aside, target = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self.fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        no_options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, target, no_options)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if not self.fs.exists(target):
                raise
            raise TidelogError(f"{name} is there already: another writer holds this store") from e

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config.from_env()
        self.files = Files(spark, self.root)
        numbers = [int(m[1]) for n in self.files.names() if (m := _MANIFEST.match(n))]
        self.version = max(numbers, default=0)
        empty = {"base": None, "runs": [], "log": [], "gone": [], "next_seq": 0, "next_id": 1, "batches": {}}
        self.manifest = json.loads(self.files.read(f"manifest-{self.version:08d}.json")) if numbers else empty

    def _commit(self, **changed) -> None:
        manifest = self.manifest | changed
        paths = lambda m: {r["path"] for r in [*m["runs"], *([m["base"]] if m["base"] else [])]} | set(m["log"])
        due, manifest["gone"] = self.manifest["gone"], sorted(paths(self.manifest) - paths(manifest))
        self.files.publish(f"manifest-{self.version + 1:08d}.json", json.dumps(manifest))
        self.manifest, self.version = manifest, self.version + 1
        for path in due:
            self.files.delete(path)
        if self.version > 2:
            self.files.delete(f"{self.root}/manifest-{self.version - 2:08d}.json")

    def _read(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def log(self, manifest: dict | None = None) -> DataFrame:
        """The ops behind the last flush, as replayed at open."""
        return self._read(OP_LOG.replace(" not null", ""), *(manifest or self.manifest)["log"])

    def entries(self, key: str | None = None, manifest: dict | None = None) -> DataFrame:
        """(segment_id, seq, key, value, tombstone) of all segments; of a key, from what may hold it. One scan of all runs and one of the base, however many segments there are."""
        m = manifest or self.manifest
        holds = lambda r: key is None or r["low"] <= key and (r["high"] is None or key <= r["high"])
        base = m["base"]
        after = base["segment_id"] if base else 0
        out = self._read(_ENTRY, *(r["path"] for r in m["runs"] if holds(r))).filter(F.col("segment_id") > after)
        if base and holds(base):
            out = out.unionByName(self._read(_ENTRY.partition(", ")[2], base["path"]).select(F.lit(after).cast("long").alias("segment_id"), "*"))
        return out if key is None else out.filter(F.col("key") == key)

    def writes(self, key: str | None = None) -> DataFrame:
        """Everything that may decide a key: (seq, key, value, tombstone) of segments and log."""
        m = self.manifest  # one, whatever is committed meanwhile
        log = self.log(m)
        return self.entries(key, m).select("seq", "key", "value", "tombstone").unionByName(log if key is None else log.filter(F.col("key") == key))

    def _range(self, path: str) -> dict:
        """A run's least and greatest key, cut to lengths that a manifest can hold; high: null where a cut one would have no successor."""
        low, high = self.spark.read.schema("key string").parquet(path).agg(F.min("key"), F.max("key")).first()
        return {"low": (low or "")[:_KEPT], "high": high if high is None or len(high) <= _KEPT else high[:_KEPT] + "\U0010ffff"}

    def append(self, ops: DataFrame, source: str | None = None, batch: int = 0) -> None:
        """ops (seq, key, value, tombstone). Flushes what fills segments.

        Without a source, seq orders ops among themselves, and all come behind what is there. A named source's seq is its
        own and stays: its rows may come late and in any order. A batch of it that was committed before is not taken again.
        """
        batches = self.manifest["batches"]
        if source is not None and batches.get(source, -1) >= batch:
            return
        path = f"{self.root}/log-{uuid.uuid4().hex}"
        low, high = ops.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            return
        shift = self.manifest["next_seq"] - low if source is None else 0
        ops.select((F.col("seq") + shift).alias("seq"), "key", "value", "tombstone").write.parquet(path)
        self._commit(log=[*self.manifest["log"], path], next_seq=max(self.manifest["next_seq"], high + shift + 1), batches=batches | ({} if source is None else {source: batch}))
        self.flush()

    def flush(self) -> None:
        """Writes the segments that the log fills, and the rest as the new log, in one commit."""
        log, capacity = self.log(), self.config.capacity
        filled = log.select("key").distinct().limit(max(capacity, 1)).count() >= capacity
        if not filled:
            return
        work = f"{self.root}/cut-{uuid.uuid4().hex}"
        assign_segments(log, capacity).write.parquet(work)
        cut = self.spark.read.parquet(work)
        # Ids follow one another, and only the last segment may be open.
        last, done = closed_segments(cut, capacity).agg(F.max("segment_id"), F.max_by("closed", "segment_id")).first()
        last -= not done
        if last:
            base, run, rest = self.manifest["next_id"] - 1, f"{self.root}/run-{uuid.uuid4().hex}", f"{self.root}/log-{uuid.uuid4().hex}"
            entries = newest(cut.filter(F.col("segment_id") <= last), keys=("segment_id", "key"), more=("seq",))
            write_run(entries.withColumn("segment_id", F.col("segment_id") + base), run)
            cut.filter(F.col("segment_id") > last).select("seq", "key", "value", "tombstone").write.parquet(rest)
            self._commit(runs=[*self.manifest["runs"], {"path": run, "last": base + last} | self._range(run)], log=[rest], next_id=base + last + 1)
        self.files.delete(work)

    def compact(self, rounds: int = 1, purge: bool = False) -> int:
        """Merges the rounds + 1 oldest segments into one, under the newest's id. How many went.

        Tombstones stay unless purge is asked for, which is right where no row comes later that is older than they.
        """
        base = self.manifest["base"]
        first, newest_id = base["segment_id"] if base else 1, self.manifest["next_id"] - 1
        last = min(first + rounds, newest_id)
        if last <= first:
            return 0
        path = f"{self.root}/base-{uuid.uuid4().hex}"
        merged = merge_runs(self.entries().filter(F.col("segment_id") <= last), purge, "seq", ("seq",))
        write_run(merged, path)
        self._commit(base={"path": path, "segment_id": last} | self._range(path), runs=[r for r in self.manifest["runs"] if r["last"] > last])
        return last - first


class Engine:
    """Sets, gets and deletes over a store; batches are the natural size of a call."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.store, self.running, self._ticker = spark, Store(spark, path, config), True, None

    def apply(self, requests: DataFrame) -> DataFrame:
        """requests (seq, op, key, value), as a session: stored (seq, key, outcome, value) responses, gets as of their place. A record too large fails alone."""
        self._check()
        from tidelog.operators.resolve import session_responses

        good = requests.filter("op <> 'get'").filter(~too_large("key", "value"))
        base = newest(self.store.writes().join(requests.filter("op = 'get'").select("key").distinct(), "key", "left_semi"))
        low = requests.agg(F.min("seq")).first()[0]
        if low is None:
            return self.spark.createDataFrame([], "seq bigint, key string, outcome string, value string")
        before = base.select(F.lit(low - 1).cast("long").alias("seq"), F.when(F.col("tombstone"), "delete").otherwise("set").alias("op"), "key", "value")
        known = before.unionByName(requests.filter((F.col("op") == "get") | ~too_large("key", "value")).select("seq", "op", "key", "value"))
        answers = session_responses(known).filter(F.col("seq") >= low)
        failed = requests.filter(F.col("op") != "get").filter(too_large("key", "value")).select("seq", "key", F.lit("failed").alias("outcome"), F.lit(None).cast("string").alias("value"))
        path = f"{self.store.root}/answers-{uuid.uuid4().hex}"
        answers.unionByName(failed).write.parquet(path)
        self.store.append(good.select("seq", "key", "value", (F.col("op") == "delete").alias("tombstone")))
        return self.spark.read.parquet(path)

    def _check(self) -> None:
        if not self.running:
            raise TidelogError("the engine was stopped")

    def _one(self, op: str, key: str, value: str | None) -> None:
        self._check()
        for part, text in (("key", key), ("value", value)):
            if text is not None and (n := len(text.encode())) > MOST:
                raise TooLarge(part, n, MOST)
        self.store.append(self.spark.createDataFrame([(0, key, value, op == "delete")], OP_LOG.replace(" not null", "")))

    def set(self, key: str, value: str) -> None:
        self._one("set", key, value)

    def delete(self, key: str) -> None:
        """Blind: a key that isn't there is deleted as well."""
        self._one("delete", key, None)

    def get(self, key: str) -> str | None:
        self._check()
        while True:
            version = self.store.version
            try:
                found = live(self.store.writes(key)).first()
                return found["value"] if found else None
            except Exception:
                if version == self.store.version:  # else its files went meanwhile
                    raise

    def require(self, key: str) -> str:
        if (found := self.get(key)) is None:
            raise NotFound(key)
        return found

    def batch_get(self, keys: DataFrame) -> DataFrame:
        self._check()
        return batch_get(self.store.writes(), keys)

    def list(self) -> DataFrame:
        self._check()
        return list_keys(self.store.writes())

    def state(self) -> DataFrame:
        return live(self.store.writes())

    def segments(self) -> DataFrame:
        return list_of(self.store.entries())

    def inspect(self, segment_id: int) -> DataFrame:
        """The sparse index of a segment; no rows for one that isn't there."""
        base = self.store.manifest["base"]
        ranges = 256 if base and base["segment_id"] == segment_id else 1
        return segment_inspect(sparse_index(self.store.entries().filter(F.col("segment_id") == segment_id).drop("seq"), ranges=ranges), segment_id)

    def compact(self, rounds: int = 1, purge: bool = False) -> int:
        self._check()
        return self.store.compact(rounds, purge)

    def tick(self, now: float) -> int:
        """The scheduler's step, to be called as often as one likes: one round where the interval has passed and two segments are there."""
        self._check()
        if not self.store.config.compaction_enabled:
            return 0
        if self._ticker is None:
            self._ticker = now
        if now - self._ticker < self.store.config.compaction_interval_seconds:
            return 0
        self._ticker = now
        return self.compact()

    def stop(self) -> None:
        """No more calls; what was committed stays."""
        self.running = False


def requests_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A batch from (op, key, value) tuples, in order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUEST)
