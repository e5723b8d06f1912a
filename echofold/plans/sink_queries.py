"""Publishing, claiming and appending over the driver tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.plans.tables import table
from echofold.scratch import new_path
from echofold.sinks.claims import AppendedIndex, ClaimLog
from echofold.sinks.publish import ObjectStore, counters, publish

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _tasks(docs, changed):
    """Each document as an object of its language's class; every 97th is stated with a digest that isn't its own."""
    body = F.encode(F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8")
    stated = F.when(F.col("doc_id") % 97 == 5, F.sha2(F.lit("else").cast("binary"), 256)).otherwise(F.sha2(body, 256))
    source = F.when(F.col("doc_id") % 2 == 0, "ledger.jsonl").otherwise("computed-at-import")
    return docs.select(F.col("lang").alias("object_class"), F.col("doc_id").cast("string").alias("logical_id"), F.col("doc_id").alias("ord"), body.alias("body"), stated.alias("expected_digest"), F.octet_length(body).cast("long").alias("expected_bytes"), source.alias("digest_source"))


_PUBLISH = """WITH b AS (SELECT r.run, lang AS object_class, doc_id, CASE WHEN r.run = 2 AND doc_id % 101 = 50 AND lang = 'en' THEN text || '!' ELSE text END AS body FROM documents, (VALUES (1), (2)) r(run)),
j AS (SELECT *, sha256(body) AS digest, strlen(body) AS bytes, CASE WHEN doc_id % 97 = 5 THEN CASE WHEN doc_id % 2 = 0 THEN 'source_digest_mismatch' ELSE 'readback_mismatch' END END AS reason FROM b),
c AS (SELECT object_class, min(doc_id) AS halt FROM j WHERE run = 2 AND reason IS NULL AND doc_id % 101 = 50 AND object_class = 'en' GROUP BY 1),
d AS (SELECT j.*, run = 2 AND c.halt IS NOT NULL AND doc_id > c.halt AS deferred, run = 2 AND c.halt IS NOT NULL AND doc_id = c.halt AS conflict FROM j LEFT JOIN c USING (object_class)),
o AS (SELECT *, CASE WHEN deferred THEN 'deferred' WHEN reason IS NOT NULL OR conflict THEN 'quarantined' WHEN run = 2 THEN 'replayed' ELSE 'published' END AS outcome, CASE WHEN deferred THEN 'class_halted' WHEN conflict THEN 'pointer_conflict' ELSE reason END AS why,
 NOT deferred AND reason IS NULL AND row_number() OVER (PARTITION BY digest, NOT deferred AND reason IS NULL ORDER BY run, doc_id) > 1 AS deduped FROM d)
SELECT run, object_class, outcome, why AS reason, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN deduped THEN 1 ELSE 0 END) AS BIGINT) AS n_deduped FROM o GROUP BY ALL"""


@query(_PUBLISH)
def published_objects(spark, sf_dir):
    """All documents published twice; the second time one class has a text that changed."""
    docs = table(spark, sf_dir, "documents")
    store = ObjectStore(spark, new_path(spark))
    runs = [publish(store, _tasks(docs, F.lit(False))), publish(store, _tasks(docs, (F.col("doc_id") % 101 == 50) & (F.col("lang") == "en")))]
    return counters(runs[0].outcomes).select(F.lit(1).alias("run"), "*").unionByName(counters(runs[1].outcomes).select(F.lit(2).alias("run"), "*"))


@query(
    "WITH l AS (SELECT event_id, epoch_us(ts) / 1e6 AS due FROM events), a AS (SELECT *, row_number() OVER (ORDER BY due, CAST(event_id AS VARCHAR)) AS k FROM l), n AS (SELECT count(*) // 10 AS m FROM l) "
    "SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN k <= m THEN 'a' WHEN k <= 2 * m THEN 'b' ELSE 'c' END AS worker, k <= 2 * m AND event_id % 3 <> 0 OR k > 2 * m AS accepted FROM a, n WHERE k <= 2 * m AND event_id % 3 <> 0 "
    "UNION ALL SELECT CAST(event_id AS VARCHAR), 'c', true FROM (SELECT *, row_number() OVER (ORDER BY k) AS r FROM a, n WHERE k > 2 * m OR event_id % 3 = 0), n WHERE r <= n.m "
    "UNION ALL SELECT CAST(event_id AS VARCHAR), CASE WHEN k <= m THEN 'a' ELSE 'b' END, false FROM a, n WHERE k <= 2 * m AND event_id % 3 = 0"
)
def leased_claims(spark, sf_dir):
    """Two workers claim a tenth of the events each and finish two thirds of it in time; a third one claims what is free when their leases have run out, and only then do they come back with the rest."""
    events = table(spark, sf_dir, "events")
    ledger = events.select(F.col("event_id").cast("string").alias("record_id"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("next_attempt_at"), "event_id")
    share = events.count() // 10
    log, now = ClaimLog(spark, new_path(spark)), 4e9
    claims = {w: log.claim(ledger, w, share, 60.0, now) for w in ("a", "b")}
    done, late = (claims["a"].unionByName(claims["b"]).where(c).select("record_id", "token", "worker", F.lit("done").alias("state")) for c in ("event_id % 3 <> 0", "event_id % 3 = 0"))
    results = log.finish(done.drop("worker"), now + 30).join(done.select("record_id", "worker"), "record_id")
    third = log.claim(ledger, "c", share, 60.0, now + 61)
    fenced = log.finish(late.drop("worker"), now + 62).join(late.select("record_id", "worker"), "record_id")
    mine = third.select("record_id", "token", F.lit("done").alias("state"))
    last = log.finish(mine, now + 90).withColumn("worker", F.lit("c"))
    return results.unionByName(fenced).unionByName(last).select("record_id", "worker", "accepted")


@query("SELECT user_id AS key, max(event_id) AS at, arg_max(event_type, event_id) AS outcome, count(*) AS n_rows FROM events GROUP BY 1")
def appended_index(spark, sf_dir):
    """Events appended in three batches, one of them twice; the last row of each key, and how many there are."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("outcome"))
    index, schema = AppendedIndex(spark, new_path(spark)), e.schema.simpleString()[7:-1].replace(":", " ")
    bounds = e.agg(F.min("at"), F.max("at")).first()
    width = (bounds[1] - bounds[0]) // 3 + 1 if bounds[0] is not None else 1
    for k in (0, 1, 1, 2):
        index.append(f"batch-{k}", e.where(F.floor((F.col("at") - F.lit(bounds[0] or 0)) / width) == k))
    rows = index.rows(schema).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    return index.current(schema, "key", "at").drop("generation").join(rows, "key")


@query(
    "WITH i AS (SELECT o_orderkey AS clip_key, CASE WHEN o_orderkey % 9 <> 4 THEN epoch(CAST(o_orderdate AS TIMESTAMP)) END AS t, CAST(o_custkey * 1000 AS DOUBLE) AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), "
    "c AS (SELECT *, sum(bytes) OVER () - sum(bytes) OVER () * 3 // 5 AS excess, coalesce(sum(bytes) OVER (ORDER BY t IS NOT NULL, coalesce(t, mtime), clip_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i) SELECT clip_key, bytes, before < excess AS pruned FROM c"
)
def pruned_clips(spark, sf_dir):
    """Which clips' sound goes so that three fifths of the bytes stay: those without a time, then the oldest."""
    from echofold.sinks.buffer import pruned

    t = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))").cast("double")
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_key"), F.when(F.col("o_orderkey") % 9 != 4, t).alias("t"), (F.col("o_custkey") * 1000).cast("double").alias("mtime"), F.floor("o_totalprice").cast("long").alias("bytes"))
    total = index.agg(F.sum("bytes")).first()[0] or 0
    return pruned(index, total * 3 // 5).select("clip_key", "bytes", "pruned")
