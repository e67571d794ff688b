"""Newest-wins resolution and reads. State is one row per key: partial max_by before the only shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.ranges import quantiles, range_of

#: Keys of a batch that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Ranges into which a session's seq is cut for as-of reads.
AS_OF_BUCKETS = 256


def newest(log: DataFrame, by: str = "seq", keys: tuple[str, ...] = ("key",), more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, tombstone, more) of each key's last write. by must be unique within a key."""
    own = ("value", "tombstone", *more)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*own), by).alias("last")).select(*keys, *(f"last.{c}" for c in own))


def live(log: DataFrame) -> DataFrame:
    return newest(log).filter("not tombstone").select("key", "value")


def list_keys(log: DataFrame) -> DataFrame:
    """Live keys in byte order. Values aren't read."""
    gone = log.groupBy("key").agg(F.max_by("tombstone", "seq").alias("tombstone"))
    return gone.filter("not tombstone").select("key").orderBy("key")


def tombstoned(log: DataFrame) -> DataFrame:
    gone = log.groupBy("key").agg(F.max_by("tombstone", "seq").alias("tombstone"))
    return gone.filter("tombstone").select("key")


def point_get(log: DataFrame, key: str) -> DataFrame:
    """No row, or the one live (key, value). The key filter reaches the scan."""
    return live(log.filter(F.col("key") == key))


def probe(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Three-state lookup of keys (key) in a resolved state: absent, tombstone or value."""
    few = keys.count() <= BROADCAST_KEYS
    # Only what the batch asks for is kept of the state; where that is little, the state isn't shuffled.
    held = state.join(F.broadcast(keys.distinct()) if few else keys.distinct(), "key", "left_semi")
    found = keys.join(held, "key", "left")
    state_of = F.when(F.col("tombstone").isNull(), "absent").when(F.col("tombstone"), "tombstone").otherwise("value")
    return found.select("key", state_of.alias("state"), "value")


def batch_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, state, value) for each row of keys. Only the wanted keys are resolved."""
    few = keys.count() <= BROADCAST_KEYS
    wanted = log.join(F.broadcast(keys.distinct()) if few else keys.distinct(), "key", "left_semi")
    return probe(newest(wanted), keys)


def asof_reads(session: DataFrame, buckets: int = AS_OF_BUCKETS) -> DataFrame:
    """(seq, key, outcome, value) of each get, which sees the last write of its key before it.

    A key's requests are cut into at most `buckets` ranges of seq, of as many requests each, and resolved on their own:
    one key may be most of the session. What a range starts from is the last write of the ranges before, a row a key and range.
    """
    placed = session.select("seq", "op", "key", "value", range_of(F.col("seq"), quantiles(session, "seq", buckets)).alias("bucket"))
    is_write, write = F.col("op") != "get", F.struct("op", "value")
    ends = placed.groupBy("key", "bucket").agg(F.max_by(write, F.when(is_write, F.col("seq"))).alias("end"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("key", "bucket", F.last("end", ignorenulls=True).over(earlier).alias("start"))
    before = Window.partitionBy("key", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.join(starts, ["key", "bucket"]).withColumn("seen", F.last(F.when(is_write, write), ignorenulls=True).over(before))
    seen = within.filter(~is_write).withColumn("seen", F.coalesce("seen", "start"))
    hit = F.coalesce(F.col("seen.op") == "set", F.lit(False))
    return seen.select("seq", "key", F.when(hit, "ok").otherwise("not_found").alias("outcome"), F.when(hit, F.col("seen.value")).alias("value"))


def session_responses(session: DataFrame) -> DataFrame:
    """(seq, key, outcome, value) of every request: gets as of their place, sets and deletes ok, or failed if too large."""
    from tidelog.functions.codec import too_large

    done = session.filter("op <> 'get'").select("seq", "key", F.when(too_large("key", "value"), "failed").otherwise("ok").alias("outcome"), F.lit(None).cast("string").alias("value"))
    return asof_reads(session).unionByName(done)
