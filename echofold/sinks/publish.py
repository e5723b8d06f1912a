"""Objects published under pointers: staged, read back against the digest stated for them, stored once by digest, and pointed at by one commit.

Tasks are rows (object_class, logical_id, ord, body, expected_digest, expected_bytes, digest_source). What happens to one depends on those before it in
``ord``: a logical id keeps the first object it is given, a second one that differs is a conflict, and a conflict halts its class. All this is decided by
joins and by windows over a logical id or a digest; no class is gathered.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from echofold.scratch import written
from echofold.sinks.commits import CommitLog, Lease, Leases, names

#: Where a digest comes from that was taken when the object was fetched.
STRONG_SOURCES = ("ledger.jsonl", "index.jsonl", "pinned-constant")
TASK = "object_class string, logical_id string, ord long, body binary, expected_digest string, expected_bytes long, digest_source string"
_BLOB = "digest string, bytes long, body binary"
_POINTER = "object_class string, logical_id string, digest string, bytes long, ord long"


@dataclass(frozen=True)
class Published:
    """A run: what became of each task (without bodies), the generation it made (None if it made none), and why it was aborted, if it was."""

    outcomes: DataFrame
    generation: int | None
    aborted: str | None


class ObjectStore:
    """Blobs and pointers in a shared folder. Blobs of a run that was never committed stay and are found again; its pointers are never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")
        self.leases = Leases(spark, f"{self.root}/leases")

    def _rows(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pointers(self, generation: int | None = None) -> DataFrame:
        runs = [e["run"] for e in self.log.entries(generation)]
        return self._rows([f"{self.root}/pointers/{r}" for r in runs], _POINTER)

    def blobs(self) -> DataFrame:
        """Blobs of every run that wrote all of its own, committed or not. Two runs may have the same one."""
        whole = [r for r in names(self.spark, f"{self.root}/blobs") if "_SUCCESS" in names(self.spark, f"{self.root}/blobs/{r}")]
        return self._rows([f"{self.root}/blobs/{r}" for r in whole], _BLOB)

    def objects(self) -> DataFrame:
        """object_class, logical_id, digest and body of everything that is pointed at."""
        bodies = self.blobs().dropDuplicates(["digest"]).select("digest", "body")
        return self.pointers().select("object_class", "logical_id", "digest").join(bodies, "digest").select("object_class", "logical_id", "digest", "body")


def _judged(staged: DataFrame) -> DataFrame:
    """Staged rows, as read back, with ``reason``: the first thing wrong with one by itself."""
    actual, expected = F.sha2("body", 256), F.coalesce("expected_digest", "digest")
    strong = F.col("digest_source").isin(*STRONG_SOURCES)
    reason = (
        F.when(F.col("body").isNull(), "source_unreadable")
        .when(strong & (F.col("digest") != expected), "source_digest_mismatch")
        .when((F.octet_length("body") != F.col("expected_bytes")) & (F.col("digest") == expected), "length_mismatch_on_digest_match")
        .when(actual != expected, "readback_mismatch")
    )
    return staged.select("object_class", "logical_id", "ord", "digest", F.octet_length("body").cast("long").alias("bytes"), reason.alias("reason"))


def publish(store: ObjectStore, tasks: DataFrame, lease: Lease | None = None, resume: bool = False, now: float | None = None, fail_before_commit: bool = False) -> Published:
    """Publishes ``tasks`` (columns of TASK; ``ord`` tells them apart).

    Outcomes (object_class, logical_id, ord, outcome, reason, deduped, bytes): ``published``, ``replayed`` (the pointer has that object already),
    ``quarantined`` with a reason, ``deferred`` (behind a conflict in its class) and, with ``resume``, ``skipped_done`` for ids that are published. ``deduped`` says that the
    blob was there already. A conflict is quarantined as ``pointer_conflict``. If the lease isn't live, or another run commits first, the run is aborted and nothing becomes
    visible. An empty table gives an empty commit. ``fail_before_commit`` is for tests: it ends the run where blobs are written and pointers aren't seen.
    """
    spark, run = store.spark, uuid.uuid4().hex
    planned_on = store.log.generation()
    fields = [F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(TASK).fields]
    path = f"{store.root}/staging/{run}"
    tasks.select(*fields).withColumn("digest", F.sha2("body", 256)).write.parquet(path)
    staged = spark.read.schema(f"{TASK}, digest string").parquet(path)
    # Blobs that are there already are read again before anything points at them.
    there = store.blobs().groupBy("digest").agg(F.bool_and(F.coalesce((F.sha2("body", 256) == F.col("digest")) & (F.octet_length("body") == F.col("bytes")), F.lit(False))).alias("sound"))
    held = store.pointers(planned_on).select("object_class", "logical_id", F.col("digest").alias("held"))
    rows = _judged(staged).join(there, "digest", "left").join(held, ["object_class", "logical_id"], "left")
    rows = rows.withColumn("skipped", F.col("held").isNotNull() & F.lit(resume))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("sound"), "stored_blob_corrupt").otherwise(F.col("reason")))
    good = F.col("reason").isNull() & ~F.col("skipped")
    # The object that a logical id has, or the first one that it is given.
    of_id = Window.partitionBy("object_class", "logical_id").orderBy("ord")
    before = of_id.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("wanted", F.coalesce("held", F.first(F.when(good, F.col("digest")), ignorenulls=True).over(before))).withColumn("good", good)
    rows = rows.withColumn("earlier", F.coalesce(F.max(F.col("good").cast("int")).over(of_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    rows = written(rows.withColumn("conflict", F.col("good") & (F.col("digest") != F.col("wanted"))))
    # One row a class.
    halts = rows.where("conflict").groupBy("object_class").agg(F.min("ord").alias("halt"))
    rows = rows.join(halts, "object_class", "left").withColumn("deferred", F.coalesce(F.col("ord") > F.col("halt"), F.lit(False)))
    firsts = rows.where("good and not deferred").groupBy("digest").agg(F.min("ord").alias("first"))
    rows = rows.join(firsts, "digest", "left")
    outcome = (
        F.when(F.col("deferred"), "deferred").when(F.col("skipped"), "skipped_done").when(F.col("reason").isNotNull() | F.col("conflict"), "quarantined")
        .when(F.col("held").isNotNull() | F.col("earlier"), "replayed").otherwise("published")
    )
    stored = F.col("good") & ~F.col("deferred")
    out = rows.select(
        "object_class", "logical_id", "ord", outcome.alias("outcome"),
        F.when(F.col("deferred"), "class_halted").when(F.col("skipped"), None).when(F.col("conflict"), "pointer_conflict").otherwise(F.col("reason")).alias("reason"),
        (stored & (F.coalesce("sound", F.lit(False)) | (F.col("first") < F.col("ord")))).alias("deduped"), "bytes", "digest", (stored & F.col("sound").isNull() & (F.col("first") == F.col("ord"))).alias("new"),
    )
    out = written(out)
    # Only the first body of each new digest is written.
    staged.select("ord", "digest", F.octet_length("body").cast("long").alias("bytes"), "body").join(out.where("new").select("ord"), "ord").select("digest", "bytes", "body").write.parquet(f"{store.root}/blobs/{run}")
    out.where("outcome = 'published'").select("object_class", "logical_id", "digest", "bytes", "ord").write.parquet(f"{store.root}/pointers/{run}")
    report = out.drop("digest", "new")
    if fail_before_commit:
        return Published(report, None, "failed")
    if lease is not None and not store.leases.live(lease, time.time() if now is None else now):
        return Published(report, None, "lease_fenced")
    if not store.log.commit(planned_on, {"run": run, "epoch": lease.epoch if lease else None}):
        return Published(report, None, "lost_generation")
    return Published(report, planned_on + 1, None)


def counters(outcomes: DataFrame) -> DataFrame:
    """n and bytes by class, outcome and reason, and how many of them were deduplicated."""
    return outcomes.groupBy("object_class", "outcome", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.col("deduped").cast("long")).alias("n_deduped"))
