"""Queries on ordered detections, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.operators import matching as M
from echofold.operators import temporal as W
from echofold.plans.tables import DAY, DETS, HOUR, MINUTE, detections, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {DETS}, b AS (SELECT t // {MINUTE} AS bin, count(DISTINCT node) AS n_nodes FROM d GROUP BY 1) SELECT n_nodes, count(*) AS n_bins FROM b GROUP BY 1")
def coactivity_bins(spark, sf_dir):
    return W.coactivity(detections(spark, sf_dir), "t", "node", MINUTE)


@query(
    f"WITH {DETS}, b AS (SELECT DISTINCT t // {HOUR} AS bin, node FROM d) SELECT x.node AS node_a, y.node AS node_b, count(*) AS n_bins "
    "FROM b x JOIN b y ON x.bin = y.bin AND x.node < y.node GROUP BY 1, 2"
)
def pair_bin_cooccurrence(spark, sf_dir):
    return W.pair_cooccurrence(detections(spark, sf_dir), "t", "node", HOUR)


@query(f"WITH {DETS}, g AS (SELECT node, t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) AS gap FROM d) SELECT node, count(gap) AS n_gaps, median(gap) AS median_gap FROM g GROUP BY 1")
def median_interarrival(spark, sf_dir):
    return W.gaps(detections(spark, sf_dir), ["node"], "t", "seq").groupBy("node").agg(F.count("gap").alias("n_gaps"), F.median("gap").alias("median_gap"))


@query(
    f"WITH {DETS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) AS gap FROM d), "
    f"s AS (SELECT *, sum(CASE WHEN gap > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS session FROM g) "
    "SELECT node, CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS t_from, max(t) AS t_to FROM s GROUP BY 1, 2"
)
def burst_sessions(spark, sf_dir):
    s = W.sessions(detections(spark, sf_dir), ["node"], "t", 6 * HOUR, "seq")
    return s.groupBy("node", "session").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"))


@query(
    f"WITH {DETS}, g AS (SELECT *, t - lag(t) OVER (ORDER BY t, seq) AS gap FROM d), "
    f"s AS (SELECT *, sum(CASE WHEN gap > {10 * MINUTE} THEN 1 ELSE 0 END) OVER (ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS component FROM g) "
    "SELECT CAST(component AS BIGINT) AS component, count(*) AS n, min(t) AS t_from, max(t) AS t_to FROM s GROUP BY 1"
)
def fleet_components(spark, sf_dir):
    s = W.global_sessions(detections(spark, sf_dir), "t", 10 * MINUTE, DAY, "seq")
    return s.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"))


@query(f"WITH {DETS} SELECT node, seq, row_number() OVER (PARTITION BY node ORDER BY t, seq) - 1 AS ordinal FROM d")
def node_ordinals(spark, sf_dir):
    return W.ordinals(detections(spark, sf_dir), ["node"], "t", "seq").select("node", "seq", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {DETS} SELECT seq, coalesce(t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) < {HOUR}, false) AS is_retrigger FROM d")
def retrigger_flags(spark, sf_dir):
    return W.gaps(detections(spark, sf_dir), ["node"], "t", "seq").select("seq", F.coalesce(F.col("gap") < HOUR, F.lit(False)).alias("is_retrigger"))


@query(
    f"WITH {DETS}, b AS (SELECT *, last_value(CASE WHEN source = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY node ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, "
    "first_value(CASE WHEN source = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY node ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM d) "
    "SELECT seq, CASE WHEN source = 'signup' THEN 'anchored' WHEN before IS NULL THEN 'pre_lock' WHEN after IS NULL THEN 'after_last_anchor' WHEN abs(before - after) > 20 THEN 'disagrees' ELSE 'recovered' END AS bracket, before, after FROM b"
)
def nearest_bracket(spark, sf_dir):
    d = detections(spark, sf_dir)
    return W.brackets(d, ["node"], "t", "seq", "value", F.col("source") == "signup", 20.0).select("seq", "bracket", "before", "after")


@query(
    "WITH g AS (SELECT conv_id, turn, greatest(coalesce(turn - max(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0), 0) AS missing FROM conversations) "
    "SELECT conv_id, count(*) AS n_turns, CAST(sum(missing) AS BIGINT) AS missing FROM g GROUP BY 1"
)
def sequence_gaps(spark, sf_dir):
    g = W.sequence_gaps(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")
    return g.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("missing").alias("missing"))


@query(
    f"WITH {DETS}, s AS (SELECT *, t - min(t) OVER (PARTITION BY source) AS u FROM d), b AS (SELECT *, u // {6 * HOUR} AS block, (u % {6 * HOUR} < {HOUR // 2} AND u // {6 * HOUR} > 0) AS inside FROM s), "
    "h AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY source, block) AS held FROM b) "
    "SELECT source, block, CASE WHEN inside THEN 'in_guard' WHEN held < 8 THEN 'small_block' ELSE 'kept' END AS fate, count(*) AS n FROM h GROUP BY 1, 2, 3"
)
def guard_blocks(spark, sf_dir):
    b = W.guard_blocks(detections(spark, sf_dir), ["source"], "t", 6 * HOUR, HOUR // 2, 8)
    return b.groupBy("source", "block", "fate").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {DETS}, f AS (SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY node ORDER BY t, seq) THEN 1 ELSE 0 END AS fell FROM d), "
    "s AS (SELECT *, sum(fell) OVER (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS segment FROM f) "
    "SELECT node, CAST(segment AS BIGINT) AS segment, count(*) AS n FROM s GROUP BY 1, 2"
)
def boot_segments(spark, sf_dir):
    s = W.segments(detections(spark, sf_dir), ["node"], ["t", "seq"], ["value"])
    return s.groupBy("node", "segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {DETS}, g AS (SELECT node, source, seq - lag(seq) OVER (PARTITION BY node, source ORDER BY seq) - 1 AS lost FROM d) "
    "SELECT node, source, count(*) AS pages, CAST(sum(lost) AS BIGINT) AS lost, count(*) - count(lost) AS unmeasured FROM g GROUP BY 1, 2"
)
def live_ring_loss(spark, sf_dir):
    d = detections(spark, sf_dir)
    g = W.gaps(d, ["node", "source"], "seq", name="step").withColumn("lost", F.col("step") - 1)
    return g.groupBy("node", "source").agg(F.count(F.lit(1)).alias("pages"), F.sum("lost").alias("lost"), (F.count(F.lit(1)) - F.count("lost")).alias("unmeasured"))


@query(
    f"WITH {DETS}, p AS (SELECT seq, value, lag(value) OVER (PARTITION BY node ORDER BY t, seq) AS prev FROM d) "
    "SELECT seq, CASE WHEN prev IS NULL THEN 'first_run' WHEN value < prev THEN 'rolled' WHEN value - prev < 1 THEN 'sub_row' ELSE 'gap' END AS kind FROM p"
)
def byte_range_gap(spark, sf_dir):
    prev = F.lag("value").over(W.over(["node"], "t", "seq"))
    kind = F.when(prev.isNull(), "first_run").when(F.col("value") < prev, "rolled").when(F.col("value") - prev < 1, "sub_row").otherwise("gap")
    return detections(spark, sf_dir).select("seq", kind.alias("kind"))


@query(
    f"WITH {DETS}, o AS (SELECT *, coalesce(last_value(CASE WHEN value >= 60 THEN true WHEN value < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING), false) AS open FROM d), "
    "e AS (SELECT *, CASE WHEN open AND NOT coalesce(lag(open) OVER (PARTITION BY node ORDER BY t, seq), false) THEN 1 ELSE 0 END AS begins FROM o) "
    "SELECT node, CAST(sum(begins) AS BIGINT) AS n_runs, count(*) FILTER (open) AS n_open FROM e GROUP BY 1"
)
def hysteresis_runs(spark, sf_dir):
    o = W.hysteresis(detections(spark, sf_dir), ["node"], "t", "seq", "value", 60.0, 30.0)
    begins = (F.col("open") & ~F.coalesce(F.lag("open").over(W.over(["node"], "t", "seq")), F.lit(False))).cast("int")
    return o.withColumn("begins", begins).groupBy("node").agg(F.sum("begins").alias("n_runs"), F.count_if("open").alias("n_open"))


@query(
    f"WITH {DETS}, c AS (SELECT node, t, seq, value - avg(value) OVER (PARTITION BY node) AS c FROM d), "
    "l AS (SELECT node, c, lead(c, 1) OVER w AS l1, lead(c, 2) OVER w AS l2, lead(c, 4) OVER w AS l4 FROM c WINDOW w AS (PARTITION BY node ORDER BY t, seq)), "
    "u AS (SELECT node, 1 AS lag, c, l1 AS x FROM l UNION ALL SELECT node, 2, c, l2 FROM l UNION ALL SELECT node, 4, c, l4 FROM l) "
    "SELECT node, lag, count(x) AS n_pairs, round(sum(c * x) / sum(c * c), 6) AS acf FROM u GROUP BY 1, 2"
)
def decorrelation_lags(spark, sf_dir):
    a = W.lag_products(detections(spark, sf_dir), ["node"], "t", "seq", "value", [1, 2, 4])
    return a.withColumn("acf", F.round("acf", 6))


@query(
    f"WITH {DETS}, c AS (SELECT node, seq, t - {HOUR} AS l_from, t + {HOUR} AS l_to FROM d WHERE source = 'purchase'), s AS (SELECT node, seq, t AS r_from, t + {2 * HOUR} AS r_to FROM d WHERE source = 'view') "
    "SELECT c.node, c.seq AS l_id, s.seq AS r_id, count(*) OVER (PARTITION BY c.seq) AS n_partners, count(*) OVER (PARTITION BY c.seq) > 64 AS truncated FROM c JOIN s ON c.node = s.node AND s.r_from < c.l_to AND s.r_to > c.l_from "
    "QUALIFY row_number() OVER (PARTITION BY c.seq ORDER BY s.r_from, s.seq) <= 64"
)
def interval_overlap_join(spark, sf_dir):
    """Clips with the scenes that they overlap, the first 64 of each; how many there are, and whether that is more, stands beside every one."""
    d = detections(spark, sf_dir)
    clips = d.where("source = 'purchase'").select("node", F.col("seq").alias("l_id"), (F.col("t") - HOUR).alias("l_from"), (F.col("t") + HOUR).alias("l_to"))
    scenes = d.where("source = 'view'").select("node", F.col("seq").alias("r_id"), F.col("t").alias("r_from"), (F.col("t") + 2 * HOUR).alias("r_to"))
    return M.overlapping(clips, scenes, "node", 2 * HOUR, most=64).select("node", "l_id", "r_id", "n_partners", "truncated")


@query(
    f"WITH {DETS} SELECT x.node AS node_a, y.node AS node_b, count(*) AS n_pairs FROM d x JOIN d y ON x.node < y.node AND abs(x.t - y.t) <= {2 * MINUTE} "
    "GROUP BY 1, 2"
)
def band_join_counts(spark, sf_dir):
    return M.pair_counts(detections(spark, sf_dir).select("node", "t"), 2 * MINUTE).withColumnRenamed("n", "n_pairs")


@query(
    f"WITH {DETS} SELECT x.node, x.seq AS l_id, x.t AS l_t, y.seq AS r_id, y.t AS r_t, abs(x.t - y.t) AS distance FROM d x JOIN d y ON x.node = y.node AND abs(x.t - y.t) <= {12 * HOUR} "
    "WHERE x.source = 'click' AND y.source = 'purchase' QUALIFY row_number() OVER (PARTITION BY x.seq ORDER BY abs(x.t - y.t), y.t, y.seq) = 1"
)
def nearest_match(spark, sf_dir):
    d = detections(spark, sf_dir)
    a = d.where("source = 'click'").select("node", F.col("seq").alias("l_id"), F.col("t").alias("l_t"))
    b = d.where("source = 'purchase'").select("node", F.col("seq").alias("r_id"), F.col("t").alias("r_t"))
    return M.nearest(a, b, 12 * HOUR, ["node"])


@query(
    f"WITH {DETS}, p AS (SELECT x.seq AS l_id, y.seq AS r_id, abs(x.t - y.t) AS dt, abs((((x.value - y.value + 180) % 360) + 360) % 360 - 180) AS da FROM d x JOIN d y ON abs(x.t - y.t) <= {10 * MINUTE} WHERE x.source = 'error' AND y.source = 'signup') "
    f"SELECT l_id, r_id, round(dt / {10 * MINUTE} + da / 15.0, 4) AS score FROM p WHERE da <= 15"
)
def bearing_correlation(spark, sf_dir):
    d = detections(spark, sf_dir)
    a = d.where("source = 'error'").select(F.col("seq").alias("l_id"), F.col("t").alias("l_t"), F.col("value").alias("l_bearing"))
    b = d.where("source = 'signup'").select(F.col("seq").alias("r_id"), F.col("t").alias("r_t"), F.col("value").alias("r_bearing"))
    return M.correlated(a, b, 10 * MINUTE, 15.0).select("l_id", "r_id", F.round("score", 4).alias("score"))


@query(
    f"WITH {DETS}, m AS (SELECT seq, s.shift, t + s.shift AS u FROM d, (VALUES (-{3 * HOUR}), (-{2 * HOUR}), (-{HOUR}), ({HOUR}), ({2 * HOUR}), ({3 * HOUR})) s(shift) WHERE source = 'view') "
    f"SELECT m.seq AS l_id, e.seq AS r_id, m.shift, abs(m.u - e.t) AS error FROM m JOIN d e ON e.source = 'purchase' AND abs(m.u - e.t) <= {5 * MINUTE} QUALIFY row_number() OVER (PARTITION BY m.seq ORDER BY abs(m.u - e.t), abs(m.shift), m.shift, e.seq) = 1"
)
def shifted_suspects(spark, sf_dir):
    d = detections(spark, sf_dir)
    unused = d.where("source = 'view'").select(F.col("seq").alias("l_id"), F.col("t").alias("l_t"))
    events = d.where("source = 'purchase'").select(F.col("seq").alias("r_id"), F.col("t").alias("r_t"))
    return M.shifted_suspects(unused, events, [k * HOUR for k in (-3, -2, -1, 1, 2, 3)], 5 * MINUTE)


@query(
    "WITH n AS (SELECT n_nationkey AS node, n_nationkey * 3.0 AS x, n_regionkey * 7.0 AS y, 0.0 AS z FROM nation) "
    "SELECT a.node AS node_a, b.node AS node_b, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 6) AS distance, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) / 343.42, 9) AS bound_s FROM n a JOIN n b ON a.node < b.node"
)
def pair_bounds_dim(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    survey = n.select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 3.0).alias("x"), (F.col("n_regionkey") * 7.0).alias("y"), F.lit(0.0).alias("z"))
    b = M.pair_bounds(survey, 343.42)
    return b.select("node_a", "node_b", F.round("distance", 6).alias("distance"), F.round("bound_s", 9).alias("bound_s"))


@query(
    f"WITH {DETS} SELECT node, seq, CAST((dense_rank() OVER (PARTITION BY source ORDER BY t // {DAY}) - 1) % 3 AS BIGINT) AS part FROM d"
)
def holdout_parts(spark, sf_dir):
    from pyspark.sql.window import Window

    # Days are ranked, of which there are few, not rows.
    d = detections(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("day")) - 1
    days = d.select("source", "day").distinct().withColumn("part", (rank % 3).cast("long"))
    return d.join(days, ["source", "day"]).select("node", "seq", "part")
