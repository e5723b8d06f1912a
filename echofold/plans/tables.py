"""The driver tables as the engine sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: node, seq, t (epoch microseconds), source, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), micros("ts").alias("t"), F.col("event_type").alias("source"), "value")


#: The same in SQL, for use after WITH.
DETS = "d AS (SELECT user_id AS node, event_id AS seq, epoch_us(ts) AS t, event_type AS source, value FROM events)"
