"""Bloom filters as tables of set bits: no false negatives, a wanted rate of false positives.

Bit i of a key is (a + i b) mod m, with a and b from its MD5. The bits of all segments are one table, joined on
(segment, bit). Stored segments use Parquet's own Bloom filter on key; this is the explicit form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.config import BLOOM_FPR


def hashes(fpr: float = BLOOM_FPR) -> int:
    return max(1, round(-math.log2(fpr)))


def bits_for(n: Column, fpr: float = BLOOM_FPR) -> Column:
    """Bits of a filter for n entries."""
    return F.greatest(F.ceil(n * F.lit(-math.log(fpr) / math.log(2) ** 2)).cast("long"), F.lit(8).cast("long"))


def positions(key: Column, bits: Column, fpr: float = BLOOM_FPR) -> Column:
    digest = F.md5(key.cast("binary"))
    a, b = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(hashes(fpr) - 1)), lambda i: F.pmod(a + i * b, bits)))


def build(entries: DataFrame, fpr: float = BLOOM_FPR) -> tuple[DataFrame, DataFrame]:
    """((segment_id, bits), (segment_id, bit)): sizes and set bits."""
    sizes = entries.groupBy("segment_id").agg(bits_for(F.count("*"), fpr).alias("bits"))
    keyed = entries.select("segment_id", "key").join(sizes, "segment_id")
    return sizes, keyed.select("segment_id", F.explode(positions(F.col("key"), F.col("bits"), fpr)).alias("bit")).distinct()


def maybe_contains(sizes: DataFrame, set_bits: DataFrame, probes: DataFrame, fpr: float = BLOOM_FPR) -> DataFrame:
    """probes (segment_id, key) with maybe: false means the segment hasn't the key. A key that is asked again is looked up once."""
    asked = probes.select("segment_id", "key").distinct().join(sizes, "segment_id").withColumn("at", positions(F.col("key"), F.col("bits"), fpr))
    spread = asked.select("segment_id", "key", F.size("at").alias("n"), F.explode("at").alias("bit"))
    hits = spread.join(set_bits.withColumn("set", F.lit(1)), ["segment_id", "bit"], "left").groupBy("segment_id", "key").agg(F.first("n").alias("n"), F.count("set").alias("hits"))
    found = hits.select("segment_id", "key", (F.col("hits") >= F.col("n")).alias("maybe"))
    return probes.join(found, ["segment_id", "key"], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
