"""Time horizons for rows that arrive late, as batch columns and as streams.

A row newer than the settle horizon is held back, as its partners may still come; one older than the lookback can't be
associated any more, and is counted as lost unless it was emitted before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.classify import first_reason

#: Fixed values, in seconds.
SETTLE_S, LOOKBACK_S, LATE_S = 7_200, 259_200, 3_600


def horizon_class(age: Column, emitted: Column, settle: int = SETTLE_S, lookback: int = LOOKBACK_S) -> Column:
    """unanchored (no age), pending_settle, lookback_emitted, lookback_lost or admitted; both limits themselves are admitted."""
    old = age > lookback
    return first_reason([(age.isNull(), "unanchored"), (age < settle, "pending_settle"), (old & emitted, "lookback_emitted"), (old, "lookback_lost")])


def late_class(lateness: Column, late: int = LATE_S) -> Column:
    """on_time, late_arrival (up to ``late`` seconds after the settle horizon) or missing."""
    return first_reason([(lateness.isNull(), "missing"), (lateness <= 0, "on_time"), (lateness <= late, "late_arrival")], "missing")


def cursor_positions(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """How far each key has been read; taking the maximum, a cursor never moves back."""
    return rows.groupBy(*keys).agg(F.max(position).alias("position"), F.count(F.lit(1)).alias("n_rows"))


def tumbling_counts(stream: DataFrame, time: str, width: str, keys: list[str], delay: str = "2 hours") -> DataFrame:
    """Rows per key and window; on a stream, a window comes out once the watermark has passed its end."""
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def session_counts(stream: DataFrame, time: str, gap: str, keys: list[str], delay: str = "2 hours") -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_events(stream: DataFrame, keys: list[str], time: str, delay: str = "2 hours") -> DataFrame:
    """One row per key; on a stream the keys are kept as long as the watermark allows repeats."""
    if stream.isStreaming:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def append_new(path: str, key: str, partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows whose key isn't stored yet, so that a batch may be replayed.

    With ``partition``, a column that the key determines, only the partitions a batch touches are scanned for keys.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if files.exists(target) and len(files.listStatus(target)):
            stored = spark.read.schema(batch.schema).parquet(path)
            if partition is not None:
                # Pruned at run time by the batch's own partitions.
                stored = stored.join(new.select(partition).distinct(), partition, "left_semi")
            new = new.join(stored.select(key), key, "left_anti").select(*batch.columns)
        writer = new.write.mode("append")
        (writer.partitionBy(partition) if partition is not None else writer).parquet(path)

    return write
