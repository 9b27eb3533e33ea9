"""Sessions: what restores masked texts, as a table with an expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.masking import PLACEHOLDERS

SCHEMA = f"session_id string, policy_name string, placeholders {PLACEHOLDERS}, max_placeholder_len int, ttl_seconds int, created_at timestamp, expires_at timestamp"


def stamped(sessions: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    ends = F.timestamp_seconds(F.unix_micros(now) / 1e6 + F.col("ttl_seconds"))
    return sessions.withColumn("created_at", now).withColumn("expires_at", ends)


def save(sessions: DataFrame, path: str) -> None:
    stamped(sessions).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Sessions that have not expired; of several for one id the latest."""
    now = F.current_timestamp() if now is None else now
    live = spark.read.schema(SCHEMA).parquet(path).where(F.col("expires_at") > now)
    latest = live.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    return live.join(latest.withColumnRenamed("session_id", "_id"), (F.col("session_id") == F.col("_id")) & (F.col("created_at") == F.col("_at")), "left_semi")


def without(sessions: DataFrame, finished: DataFrame) -> DataFrame:
    """Sessions that are not finished; what is written back after a conversation's end."""
    return sessions.join(finished.select("session_id").distinct(), "session_id", "left_anti")
