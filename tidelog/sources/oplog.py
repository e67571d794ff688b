"""Tables as logs: every row has a unique seq, which is its recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _user() -> F.Column:
    return F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sets of a user's props; an error deletes the user."""
    gone = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _user().alias("key"), F.when(~gone, F.col("props")).alias("value"), gone.alias("tombstone"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a session: purchases and sign-ups set, errors delete, the rest get."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "set").when(F.col("event_type") == "error", "delete").otherwise("get")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("op"), _user().alias("key"), F.when(kind == "set", F.col("props")).alias("value"))


def bulk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a bulk load of unique keys."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("tombstone"))


def large_value_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sets of their source: large values, few keys."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("key"), F.col("text").alias("value"), F.lit(False).alias("tombstone"))


def writes(session: DataFrame) -> DataFrame:
    """The op log in a session: its sets and deletes."""
    return session.filter("op <> 'get'").select("seq", "key", "value", (F.col("op") == "delete").alias("tombstone"))
