"""Frames that are buffered as they come and flushed where the caller says, and a store of clips under a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.scratch import written
from echofold.sinks.claims import AppendedIndex
from echofold.sinks.commits import CommitLog

#: Kinds of frames by their length.
ROUTES = {14: "status", 172: "sketch", 173: "sketch_tagged"}


def route(frame: Column) -> Column:
    """What a frame is by its length; null is refused."""
    out = F.lit("refused")
    for size, name in ROUTES.items():
        out = F.when(F.octet_length(frame) == size, name).otherwise(out)
    return out


class FrameBuffer:
    """Rows with a time ``t`` (seconds), appended batch by batch and flushed by times.

    A flush has the rows up to its boundary that no flush before it had: those since the last boundary, and those that came late. What a flush has is fixed when it's committed,
    so it may be read again after a crash. Each row is in one flush.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.index, self.flushes, self.schema = AppendedIndex(spark, f"{root}/rows"), CommitLog(spark, f"{root}/flushes"), schema

    def ingest(self, rows: DataFrame, batch: str | int) -> bool:
        """Appends a batch; False if it is there already. Fits ``foreachBatch``."""
        return self.index.append(str(batch), rows.withColumn("route", route(F.col("frame"))))

    def flush(self, until: float) -> int:
        """Commits a flush up to ``until``, which can't go back; returns its number."""
        done = self.flushes.generation()
        if done and until < self.flushes.entries(done)[-1]["until"]:
            raise ValueError("a flush can't end before the one before it")
        if not self.flushes.commit(done, {"until": until, "seen": self.index.log.generation()}):
            raise RuntimeError("another flush was committed at the same time")
        return done + 1

    def flushed(self, number: int) -> DataFrame:
        """The rows of a flush, each with ``late``: whether its time was before the last boundary."""
        entries = self.flushes.entries(number)
        now, before = entries[-1], entries[-2] if number > 1 else {"until": None, "seen": 0}
        rows = self.index.rows(f"{self.schema}, route string").where((F.col("generation") <= now["seen"]) & (F.col("t") <= now["until"]))
        if before["until"] is None:
            return rows.withColumn("late", F.lit(False)).drop("generation")
        # What was there at the flush before, up to its boundary, was in it or in an earlier one.
        old = (F.col("generation") <= before["seen"]) & (F.col("t") <= before["until"])
        return rows.where(~old).withColumn("late", F.col("t") <= before["until"]).drop("generation")


def pruned(index: DataFrame, most_bytes: int, day: int = 86_400) -> DataFrame:
    """Rows of a clip index (clip_key, t or null, mtime, bytes, in seconds) with ``pruned``: whether the clip's sound goes so that at most ``most_bytes`` stay. The row itself stays.

    Clips without a time go first, by mtime, then the oldest days. Within a day of the order the oldest go first, ties by key. One row a day passes an unpartitioned window.
    """
    at = F.coalesce(F.col("t"), F.col("mtime"))
    rows = written(index.withColumns({"_anchored": F.col("t").isNotNull().cast("int"), "_at": at, "_bin": F.floor(at / day), "_size": F.coalesce(F.col("bytes"), F.lit(0))}))
    bins = rows.groupBy("_anchored", "_bin").agg(F.sum("_size").alias("_sum"))
    order = Window.orderBy("_anchored", "_bin")
    bins = bins.select("_anchored", "_bin", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), (F.sum("_sum").over(Window.partitionBy(F.lit(0))) - most_bytes).alias("_excess"))
    inside = Window.partitionBy("_anchored", "_bin").orderBy("_at", "clip_key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    # A clip goes if those before it don't free enough.
    return rows.join(bins, ["_anchored", "_bin"]).withColumn("pruned", earlier < F.col("_excess")).select(*index.columns, "pruned")
