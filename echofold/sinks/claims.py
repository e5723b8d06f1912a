"""Claims on due rows for several workers at once, with leases that run out, and an index that is only appended to.

The rows of a ledger never change; what happens to them is a log of claims and results, each a folder of rows that a commit makes visible. Two workers that claim at
the same time plan on the same generation, and only one of them commits it; the other one plans again and finds the rows gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.sinks.commits import CommitLog

_EVENT = "record_id string, token string, worker string, lease_until double, state string"


class ClaimLog:
    """Claims and results on the records of a ledger, in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")

    def events(self, generation: int) -> DataFrame:
        """All events of the commits up to ``generation``, each with its commit's number."""
        parts = [(n, e["run"]) for n, e in enumerate(self.log.entries(generation), 1)]
        if not parts:
            return self.spark.createDataFrame([], f"{_EVENT}, generation long")
        numbers = self.spark.createDataFrame([(r, n) for n, r in parts], "run string, generation long")
        rows = self.spark.read.schema(_EVENT).parquet(*[f"{self.root}/events/{r}" for _, r in parts])
        return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(F.broadcast(numbers), "run").drop("run")

    def state(self, generation: int | None = None) -> DataFrame:
        """The last event of each record."""
        last = self.events(self.log.generation() if generation is None else generation).groupBy("record_id")
        return last.agg(F.max_by(F.struct("token", "worker", "lease_until", "state"), "generation").alias("e")).select("record_id", "e.*")

    def _append(self, planned_on: int, rows: DataFrame) -> bool:
        run = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/events/{run}")
        return self.log.commit(planned_on, {"run": run})

    def claim(self, ledger: DataFrame, worker: str, limit: int, lease_s: float, now: float, tries: int = 10) -> DataFrame | None:
        """Up to ``limit`` rows of ``ledger`` (record_id, next_attempt_at in seconds, ...) that are due and free, oldest first, then by id; with the token that says they are the worker's.

        Free is what was never claimed, whose lease ran out, or which was given back. None if others committed first ``tries`` times.
        """
        for _ in range(tries):
            planned_on = self.log.generation()
            busy = self.state(planned_on).where((F.col("state") == "done") | ((F.col("state") == "claimed") & (F.col("lease_until") > now))).select("record_id")
            due = ledger.where(F.col("next_attempt_at") <= now).join(busy, "record_id", "left_anti")
            token = uuid.uuid4().hex
            taken = due.orderBy("next_attempt_at", "record_id").limit(limit).select("record_id", F.lit(token).alias("token"), F.lit(worker).alias("worker"), F.lit(now + lease_s).alias("lease_until"), F.lit("claimed").alias("state"))
            if self._append(planned_on, taken):
                return ledger.join(self.events(planned_on + 1).where(F.col("token") == token).select("record_id", "token", "worker", "lease_until"), "record_id")
        return None

    def finish(self, results: DataFrame, now: float, tries: int = 10) -> DataFrame | None:
        """Results (record_id, token, state: done or free) of claims. Returns them with ``accepted``: a claim that ran out, or was granted again, can't finish."""
        for _ in range(tries):
            planned_on = self.log.generation()
            held = self.state(planned_on).where((F.col("state") == "claimed") & (F.col("lease_until") > now)).select("record_id", F.col("token").alias("live"), "worker", "lease_until")
            judged = results.join(held, "record_id", "left").withColumn("accepted", F.coalesce(F.col("token") == F.col("live"), F.lit(False)))
            if self._append(planned_on, judged.where("accepted").select("record_id", "token", "worker", "lease_until", "state")):
                return judged.drop("live", "worker", "lease_until")
        return None


class AppendedIndex:
    """Rows that are appended and never rewritten. A batch that comes again is appended once; of a key's rows the last batch's counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")

    def append(self, batch: str, rows: DataFrame, tries: int = 10) -> bool:
        """False if the batch is there already."""
        run = uuid.uuid4().hex
        path = f"{self.root}/rows/{run}"
        made = False
        for _ in range(tries):
            planned_on = self.log.generation()
            if any(e["batch"] == batch for e in self.log.entries(planned_on)):
                return False
            if not made:
                rows.write.parquet(path)
                made = True
            if self.log.commit(planned_on, {"run": run, "batch": batch}):
                return True
        raise TimeoutError("others committed first each time")

    def rows(self, schema: str) -> DataFrame:
        """All rows, with the number of the commit that appended them."""
        runs = [(e["run"], n) for n, e in enumerate(self.log.entries(), 1)]
        if not runs:
            return self.spark.createDataFrame([], f"{schema}, generation long")
        numbers = self.spark.createDataFrame(runs, "run string, generation long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/rows/{r}" for r, _ in runs])
        return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(F.broadcast(numbers), "run").drop("run")

    def current(self, schema: str, key: str, *tie: str) -> DataFrame:
        """The row of each key that was appended last; within a batch the greatest by ``tie``."""
        order = Window.partitionBy(key).orderBy(F.desc("generation"), *[F.desc(c) for c in tie])
        return self.rows(schema).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
