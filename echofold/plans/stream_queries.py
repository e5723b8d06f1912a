"""Queries on what streams do, in their batch form, each with the SQL that it must agree with; tests hold the streams against it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.operators import temporal as W
from echofold.plans.tables import DETS, HOUR, detections, micros, table
from echofold.scratch import new_path
from echofold.streaming import gates
from echofold.streaming import horizons as H

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(
    f"WITH RECURSIVE {DETS}, k AS (SELECT node, seq, value + 1 AS x, row_number() OVER (PARTITION BY node ORDER BY t, seq) AS i FROM d), r AS (SELECT node, seq, i, x AS floor, true AS armed, false AS onset FROM k WHERE i = 1 "
    "UNION ALL SELECT k.node, k.seq, k.i, r.floor + CASE WHEN k.x > r.floor THEN 0.02 ELSE 0.1 END * (k.x - r.floor), CASE WHEN r.armed AND k.x > r.floor * 3 THEN false ELSE r.armed OR k.x < r.floor * 3 * 0.35 END, r.armed AND k.x > r.floor * 3 FROM r JOIN k ON k.node = r.node AND k.i = r.i + 1) "
    "SELECT node, seq, onset, CAST(floor(floor * 1000) AS BIGINT) AS floor_milli FROM r"
)
def level_gate(spark, sf_dir):
    """Onsets over a floor that follows the level."""
    d = detections(spark, sf_dir).select("node", "seq", "t", (F.col("value") + 1).alias("x"))
    return gates.level_onsets(d, "node", ["t", "seq"], "x").select("node", "seq", "onset", F.floor(F.col("floor") * 1000).alias("floor_milli"))


@query(
    f"WITH {DETS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) <= {12 * HOUR} THEN 0 ELSE 1 END AS cut FROM d), p AS (SELECT *, sum(cut) OVER (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS part FROM g), "
    "o AS (SELECT *, coalesce(last_value(CASE WHEN value >= 25 THEN true WHEN value < 8 THEN false END IGNORE NULLS) OVER (PARTITION BY node, part ORDER BY t, seq ROWS UNBOUNDED PRECEDING), false) AS open FROM p), "
    "e AS (SELECT *, CASE WHEN open AND NOT coalesce(lag(open) OVER (PARTITION BY node, part ORDER BY t, seq), false) THEN 1 ELSE 0 END AS begins FROM o), r AS (SELECT *, sum(begins) OVER (PARTITION BY node, part ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM e WHERE open) "
    "SELECT node, min(t) AS t_from, max(t) AS t_to, count(*) AS n, max(value) AS peak FROM r GROUP BY node, part, run"
)
def tonal_runs(spark, sf_dir):
    """Runs that open at one limit and close at a lower one; a gap in the stream closes them, too."""
    d = W.sessions(detections(spark, sf_dir), ["node"], "t", 12 * HOUR, "seq", name="part")
    o = W.hysteresis(d, ["node", "part"], "t", "seq", "value", 25.0, 8.0)
    order = Window.partitionBy("node", "part").orderBy("t", "seq")
    begins = (F.col("open") & ~F.coalesce(F.lag("open").over(order), F.lit(False))).cast("int")
    r = o.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("open")
    return r.groupBy("node", "part", "run").agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.count("*").alias("n"), F.max("value").alias("peak")).drop("part", "run")


@query(
    f"WITH {DETS}, w AS (SELECT node, t, value, unnest(range(t // {HOUR} - 2, t // {HOUR} + 1)) * {HOUR} AS w FROM d) SELECT node, w AS window_from, count(*) AS n, round(avg(value), 5) AS mean FROM w GROUP BY 1, 2"
)
def sliding_windows(spark, sf_dir):
    """Windows of three hours every hour."""
    d = detections(spark, sf_dir).withColumn("at", F.timestamp_micros("t"))
    w = d.groupBy("node", F.window("at", "3 hours", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))
    return w.select("node", F.unix_micros("window.start").alias("window_from"), "n", "mean")


@query(f"WITH {DETS} SELECT source, CASE WHEN seq % 11 = 0 THEN 'missing' WHEN seq % 7200 - 1800 <= 0 THEN 'on_time' WHEN seq % 7200 - 1800 <= 3600 THEN 'late_arrival' ELSE 'missing' END AS class, count(*) AS n FROM d GROUP BY 1, 2")
def lateness(spark, sf_dir):
    """How late rows came after the settle horizon; those that never came or came too late are missing."""
    late = F.expr("if(seq % 11 = 0, NULL, seq % 7200 - 1800)")
    return detections(spark, sf_dir).select("source", H.late_class(late).alias("class")).groupBy("source", "class").agg(F.count("*").alias("n"))


@query(f"WITH {DETS} SELECT source, t // {6 * HOUR} * {6 * HOUR} AS window_from, count(*) AS n FROM d GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("at", F.timestamp_micros("t"))
    return H.tumbling_counts(d, "at", "6 hours", ["source"]).select("source", F.unix_micros("window_start").alias("window_from"), "n")


@query(
    f"WITH {DETS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) <= {5 * HOUR} THEN 0 ELSE 1 END AS cut FROM d), s AS (SELECT *, sum(cut) OVER (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS part FROM g) SELECT node, min(t) AS session_from, max(t) + {5 * HOUR} AS session_to, count(*) AS n FROM s GROUP BY node, part"
)
def session_windows(spark, sf_dir):
    """Sessions that end five hours after their last row."""
    d = detections(spark, sf_dir).withColumn("at", F.timestamp_micros("t"))
    s = H.session_counts(d, "at", "5 hours", ["node"])
    return s.select("node", F.unix_micros("session_start").alias("session_from"), F.unix_micros("session_end").alias("session_to"), "n")


@query("SELECT user_id % 5 AS grp, count(DISTINCT key) AS n, max(key) AS last_key FROM (SELECT user_id, event_type || ':' || user_id AS key FROM events) GROUP BY 1")
def replayed_appends(spark, sf_dir):
    """Batches appended twice over, as after a crash: each key is stored once, and only the folders that a batch touches are read for keys."""
    key = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", key.alias("key"), (F.col("user_id") % 5).alias("grp"))
    path = new_path(spark)
    sink = H.append_new(path, "key", "grp")
    for batch in (0, 1, 0, 1):
        sink(e.where(F.col("event_id") % 2 == batch), batch)
    return spark.read.parquet(path).groupBy(F.col("grp").cast("long").alias("grp")).agg(F.count("*").alias("n"), F.max("key").alias("last_key"))


@query("SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS arrivals FROM events GROUP BY 1, 2")
def distinct_in_stream(spark, sf_dir):
    """The first of the rows with a key, and how many came."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("arrivals"))


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND user_id * 5 % 7 <> 3 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 1)")
def resumed_scores(spark, sf_dir):
    """What is still to be scored, by keys stored rather than by a position: late rows join folders that were scanned before."""
    e = table(spark, sf_dir, "events")
    done = e.where("event_id % 3 = 1").select("event_id")
    return e.where("event_type <> 'view' and user_id * 5 % 7 <> 3").join(done, "event_id", "left_anti").select("event_id")


@query(
    "WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t, (event_id * 7 + user_id) % 3 AS batch FROM events), b AS (SELECT min(t) + (max(t) - min(t)) * 0.4 AS u1, min(t) + (max(t) - min(t)) * 0.8 AS u2, max(t) AS u3 FROM e), "
    "f AS (SELECT e.*, CASE WHEN batch = 0 AND t <= u1 THEN 1 WHEN batch <= 1 AND t <= u2 THEN 2 ELSE 3 END AS flush, u1, u2 FROM e, b) "
    "SELECT flush, CASE event_id % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'sketch' WHEN 2 THEN 'sketch_tagged' ELSE 'refused' END AS route, (flush = 2 AND t <= u1) OR (flush = 3 AND t <= u2) AS late, count(*) AS n, count(DISTINCT user_id) AS n_nodes FROM f GROUP BY 1, 2, 3"
)
def routed_frames(spark, sf_dir):
    """Frames buffered in three batches, one of them sent twice, and flushed after each up to a time: by their length, and whether they came late."""
    from echofold.sinks.buffer import FrameBuffer

    size = F.expr("CASE event_id % 4 WHEN 0 THEN 14 WHEN 1 THEN 172 WHEN 2 THEN 173 ELSE 20 END")
    e = table(spark, sf_dir, "events").select(((F.col("event_id") * 7 + F.col("user_id")) % 3).alias("batch"), (micros("ts") / 1e6).alias("t"), F.col("user_id").alias("node"), F.encode(F.repeat(F.lit("x"), size), "UTF-8").alias("frame"))
    first, last = e.agg(F.min("t"), F.max("t")).first()
    buffer = FrameBuffer(spark, new_path(spark), "t double, node long, frame binary")
    out = None
    for k, share in enumerate((0.4, 0.8, 1.0)):
        for _ in range(1 + k % 2):
            buffer.ingest(e.where(F.col("batch") == k).drop("batch"), k)
        n = buffer.flush(0.0 if first is None else last if share == 1.0 else first + (last - first) * share)
        rows = buffer.flushed(n).groupBy(F.lit(n).alias("flush"), "route", "late").agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "WITH k AS (SELECT c_nationkey AS perimeter, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer), n AS (SELECT perimeter, count(*) AS n FROM k GROUP BY 1) "
    "SELECT perimeter, 'silenced' AS outcome, CAST(round(k * 0.05, 4) AS DOUBLE) AS onset_s, CAST(round((k + 4) * 0.05, 4) AS DOUBLE) AS recovered_s, CAST(15 AS DOUBLE) AS drop_db, 'a,b' AS mics, CAST(50 AS DOUBLE) AS perimeter_m, CAST(CASE WHEN k % 40 = 10 THEN 1 ELSE 0 END AS BIGINT) AS n_impacts, CAST(CASE WHEN k % 40 = 10 THEN 1.0 ELSE 0.75 END AS DOUBLE) AS confidence FROM k JOIN n USING (perimeter) WHERE k % 20 = 10 AND k + 4 < n"
)
def chorus_silences(spark, sf_dir):
    """Silences of two of three microphones around each nation's perimeter, a frame for each of its customers, every other one with an impact."""
    from echofold.streaming.tripwire import silences

    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    k = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("perimeter"), (F.row_number().over(order) - 1).alias("k"))
    t, silent = F.col("k") * 0.05, (F.col("k") % 20).between(10, 13)
    mics = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, x, y in (("a", 0.0, 0.0), ("b", 30.0, 40.0), ("c", 10.0, 0.0))]))
    levels = k.select("perimeter", "k", mics.alias("m")).select("perimeter", t.alias("t"), F.lit("level").alias("kind"), "m.name", F.when(silent & (F.col("m.name") != "c"), -35.0).otherwise(-20.0).alias("value"), "m.x", "m.y", F.lit(0.0).alias("z"))
    nothing = F.lit(None).cast("double")
    impacts = k.select("perimeter", (t - F.when(F.col("k") % 40 == 10, 0.0).otherwise(1e6)).alias("t"), F.lit("impact").alias("kind"), F.lit("s").alias("name"), nothing.alias("value"), nothing.alias("x"), nothing.alias("y"), nothing.alias("z"))
    out = silences(levels.unionByName(impacts))
    return out.select("perimeter", "outcome", F.round("onset_s", 4).alias("onset_s"), F.round("recovered_s", 4).alias("recovered_s"), F.round("drop_db", 4).alias("drop_db"), F.array_join("mics", ",").alias("mics"), F.round("perimeter_m", 4).alias("perimeter_m"), "n_impacts", "confidence")


@query(
    "WITH e AS (SELECT a.vec_id, list_min(a.embedding) AS lo, list_max(a.embedding) AS hi, len(a.embedding) AS n, b.vec_id IS NOT NULL AS two, list_max(list_transform(list_concat(a.embedding, coalesce(b.embedding, [])), lambda x: abs(x))) AS peak FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1) "
    "SELECT CAST(vec_id AS VARCHAR) AS window_id, CASE WHEN two THEN 'a' END AS reference, CASE WHEN two THEN 2 ELSE 0 END AS n_arrivals, CASE WHEN two THEN peak > 0.3 END AS speech, CASE WHEN NOT two THEN 'bad_window' END AS refusal, CASE WHEN two THEN true END AS bounded FROM e"
)
def transient_windows(spark, sf_dir):
    """What may be kept of windows of sound, each row's vector and the next one's being two nodes' clips; delays stay within what was asked."""
    from echofold.operators import clips as C

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    both = e.select("vec_id", F.lit("a").alias("node"), "samples").unionByName(e.select((F.col("vec_id") - 1).alias("vec_id"), F.lit("b").alias("node"), "samples"))
    windows = both.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("node", "samples"))).alias("clips")).join(e.select("vec_id"), "vec_id", "left_semi")
    found = C.derived_evidence(windows.select(F.col("vec_id").alias("window_id"), F.lit(16000.0).alias("fs"), "clips"), lambda x, fs: bool(abs(x).max() > 0.3), 0.001)
    bounded = F.when(F.col("arrivals").isNotNull(), F.forall("arrivals", lambda a: (F.abs(a["delay_s"]) <= 0.001 + 1 / 16000) & (a["sigma_s"] > 0)))
    return found.select("window_id", "reference", F.coalesce(F.size("arrivals"), F.lit(0)).alias("n_arrivals"), "speech", "refusal", bounded.alias("bounded"))
