"""Connected components of a links table, by alternating large-star and small-star steps on DataFrames.

Each step is a partially aggregated minimum and a join; labels stay on the executors, only two numbers a round (how many
links, and their hash sum) reach the driver. Rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for each node of links (a, b): component is the smallest node reachable. Nodes are 64-bit numbers."""
    tidy = lambda x: x.filter("a <> b").distinct()
    now, before, turn = scratch.save(tidy(links), f"{name}-0"), None, 0
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, total) == before:
            break
        before, turn = (n, total), turn + 1
        now = scratch.save(tidy(_small_star(tidy(_large_star(now)))), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    # Now every link goes from a node to its component's smallest one.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
