"""Queries on geometry, consistency and calibration, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.plans.tables import DETS, HOUR, MINUTE, detections, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _sql_events(rest: str) -> str:
    return "WITH m AS (SELECT l_orderkey AS event, l_linenumber AS node, l_suppkey % 50 * 10.0 AS x, l_partkey % 40 * 10.0 AS y, l_extendedprice / 100000 AS t FROM lineitem) " + rest


def _events(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS event", "l_linenumber AS node", "l_suppkey % 50 * 10.0D AS x", "l_partkey % 40 * 10.0D AS y", "CAST(l_extendedprice AS DOUBLE) / 100000 AS t")


_TAU = "round((b.t - a.t) + (a.node * 7 + b.node * 3 + a.event) % 11 * 0.002, 9)"


@query(
    _sql_events(
        f", p AS (SELECT a.event, a.node AS i, b.node AS j, CAST({_TAU} AS DOUBLE) AS tau, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS apart FROM m a JOIN m b ON a.event = b.event AND a.node < b.node), "
        "c AS (SELECT p.event, max(abs(p.tau + q.tau - r.tau)) AS worst FROM p JOIN p q ON q.event = p.event AND q.i = p.j JOIN p r ON r.event = p.event AND r.i = p.i AND r.j = q.j GROUP BY 1), b AS (SELECT event, count(*) FILTER (abs(tau) > apart / 343.0) AS n_beyond, count(*) AS n_pairs FROM p GROUP BY 1) "
        "SELECT event, n_pairs, n_beyond, round(worst, 7) AS worst_closure_s, coalesce(worst > 0.02, false) AS is_open, n_beyond = 0 AND NOT coalesce(worst > 0.02, false) AS valid FROM b LEFT JOIN c USING (event)"
    )
)
def array_consistency(spark, sf_dir):
    """Delays of an array's pairs: triangles must close and no delay may exceed what sound takes between its receivers."""
    m = _events(spark, sf_dir)
    a, b = m.alias("a"), m.alias("b")
    tau = F.expr(_TAU).cast("double")
    p = a.join(b, (F.col("a.event") == F.col("b.event")) & (F.col("a.node") < F.col("b.node"))).select(
        F.col("a.event").alias("event"), F.col("a.node").alias("i"), F.col("b.node").alias("j"), tau.alias("tau"), F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2)).alias("apart")
    )
    q, r = p.select("event", F.col("i").alias("j"), F.col("j").alias("k"), F.col("tau").alias("tau_q")), p.select("event", "i", F.col("j").alias("k"), F.col("tau").alias("tau_r"))
    closure = p.join(q, ["event", "j"]).join(r, ["event", "i", "k"]).groupBy("event").agg(F.max(F.abs(F.col("tau") + F.col("tau_q") - F.col("tau_r"))).alias("worst"))
    out = p.groupBy("event").agg(F.count_if(F.abs("tau") > F.col("apart") / 343.0).alias("n_beyond"), F.count("*").alias("n_pairs")).join(closure, "event", "left")
    opened = F.coalesce(F.col("worst") > 0.02, F.lit(False))
    return out.select("event", "n_pairs", "n_beyond", F.round("worst", 7).alias("worst_closure_s"), opened.alias("is_open"), ((F.col("n_beyond") == 0) & ~opened).alias("valid"))


@query(
    _sql_events(
        ", s AS (SELECT event, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM m GROUP BY 1), e AS (SELECT event, n, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS big, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c) AS small FROM s) "
        "SELECT event, n, round(sqrt(greatest(small, 0.0) / big), 4) AS flatness, n - 3 AS dof, CASE WHEN n < 3 THEN 'too_few' WHEN sqrt(greatest(small, 0.0) / big) < 0.05 THEN 'collinear' ELSE 'plane' END AS shape FROM e WHERE big > 0"
    )
)
def array_shape(spark, sf_dir):
    """How flat an array is: the ratio of its axes, from the covariance of its receivers."""
    s = _events(spark, sf_dir).groupBy("event").agg(F.count("*").alias("n"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    half, turn = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    e = s.select("event", "n", (half + turn).alias("big"), (half - turn).alias("small")).where("big > 0")
    flat = F.sqrt(F.greatest(F.col("small"), F.lit(0.0)) / F.col("big"))
    return e.select("event", "n", F.round(flat, 4).alias("flatness"), (F.col("n") - 3).alias("dof"), F.when(F.col("n") < 3, "too_few").when(flat < 0.05, "collinear").otherwise("plane").alias("shape"))


@query(
    "WITH b AS (SELECT p_partkey AS k, p_size * 2.0 AS d, p_size * 2.0 / (331.3 + 0.606 * (p_partkey % 40)) AS tau FROM part) SELECT k, round(d / tau, 4) AS c, round(d / tau * sqrt(pow(0.0001 / tau, 2) + pow(0.05 / d, 2)), 5) AS sigma_c, round((d / tau - 331.3) / 0.606, 3) AS temp_c, d / tau BETWEEN 320 AND 352 AND d / tau * sqrt(pow(0.0001 / tau, 2) + pow(0.05 / d, 2)) < 2 AS accepted FROM b"
)
def speed_from_baseline(spark, sf_dir):
    """Speed of sound from a delay over a known distance, with its error and the temperature that it implies."""
    from echofold.functions import acoustics as A

    b = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size * 2.0D AS d", "p_size * 2.0D / (331.3D + 0.606D * (p_partkey % 40)) AS tau")
    c = F.col("d") / F.col("tau")
    sigma = c * F.sqrt(F.pow(0.0001 / F.col("tau"), 2) + F.pow(0.05 / F.col("d"), 2))
    return b.select("k", F.round(c, 4).alias("c"), F.round(sigma, 5).alias("sigma_c"), F.round(A.temperature(c), 3).alias("temp_c"), (c.between(320, 352) & (sigma < 2)).alias("accepted"))


@query(
    "WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), f AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) + 1e-6 AS a, var_pop(y) + 1e-6 AS b, covar_pop(x, y) AS c FROM v GROUP BY 1) "
    "SELECT vec_id, round(sqrt((b * pow(x - mx, 2) - 2 * c * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * b - c * c)), 4) AS distance FROM v JOIN f USING (label)"
)
def mahalanobis(spark, sf_dir):
    """Distance from the own class's centre in its own covariance, in the plane of the first two axes; ``anomaly_scores`` has all of them."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    f = v.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") + 1e-6).alias("a"), (F.var_pop("y") + 1e-6).alias("b"), F.covar_pop("x", "y").alias("c"))
    dx, dy, a, b, c = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("a"), F.col("b"), F.col("c")
    return v.join(f, "label").select("vec_id", F.round(F.sqrt((b * dx * dx - 2 * c * dx * dy + a * dy * dy) / (a * b - c * c)), 4).alias("distance"))


TRIALS = 8
_MOVED = f"t // {HOUR} * {HOUR} + (t % {HOUR} + trial * (node * 7919 + trial * 104729) % 3600 * 1000000) % {HOUR}"


@query(
    f"WITH {DETS}, s AS (SELECT trial, node, {_MOVED} AS t FROM d, (SELECT unnest(range(0, {TRIALS + 1})) AS trial)), b AS (SELECT trial, t // {MINUTE} AS bin, count(DISTINCT node) AS k FROM s GROUP BY 1, 2), n AS (SELECT trial, count(*) FILTER (k >= 2) AS n FROM b GROUP BY 1) "
    f"SELECT o.n AS observed, (SELECT count(*) FROM n WHERE trial > 0 AND n.n >= o.n) AS n_at_least, round((1 + (SELECT count(*) FROM n WHERE trial > 0 AND n.n >= o.n)) / {TRIALS + 1}, 6) AS p_emp FROM n o WHERE trial = 0"
)
def shuffle_null(spark, sf_dir):
    """Minutes with several nodes, against the same after each node's times are turned round within their hour; the share counts the observation itself."""
    d = detections(spark, sf_dir).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS))))
    moved = F.expr(_MOVED.replace("//", "div"))
    b = d.select("trial", "node", moved.alias("t")).groupBy("trial", F.floor(F.col("t") / MINUTE).alias("bin")).agg(F.count_distinct("node").alias("k"))
    n = b.groupBy("trial").agg(F.count_if(F.col("k") >= 2).alias("n"))
    observed = n.where("trial = 0").select(F.col("n").alias("observed"))
    out = n.where("trial > 0").join(observed).groupBy("observed").agg(F.count_if(F.col("n") >= F.col("observed")).alias("n_at_least"))
    return out.withColumn("p_emp", F.round((1 + F.col("n_at_least")) / (TRIALS + 1), 6))


@query(
    "WITH r AS (SELECT user_id AS node, value - 20 AS r FROM events), m AS (SELECT node, median(r) AS bias, count(*) AS n FROM r GROUP BY 1) SELECT node, any_value(n) AS n, round(any_value(bias), 5) AS bias, round(1.4826 * median(abs(r - bias)), 7) AS sigma, any_value(n) >= 20 AND 1.4826 * median(abs(r - bias)) < 25 AS accepted FROM r JOIN m USING (node) GROUP BY 1"
)
def clap_calibration(spark, sf_dir):
    """A receiver's bias and scatter from claps at a known place."""
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), (F.col("value") - 20).alias("r"))
    m = r.groupBy("node").agg(F.median("r").alias("bias"), F.count("*").alias("n"))
    out = r.join(m, "node").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("bias").alias("bias"), (1.4826 * F.median(F.abs(F.col("r") - F.col("bias")))).alias("sigma"))
    return out.select("node", "n", F.round("bias", 5).alias("bias"), F.round("sigma", 7).alias("sigma"), ((F.col("n") >= 20) & (F.col("sigma") < 25)).alias("accepted"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), p AS (SELECT vec_id, v, list_max(v) AS peak FROM v), o AS (SELECT vec_id, v, peak, list_position(list_transform(v, lambda x: x >= 0.5 * peak), true) AS onset, list_position(v, peak) AS pk FROM p) "
    "SELECT vec_id, CAST(onset - 1 AS INTEGER) AS onset, CAST(pk - 1 AS INTEGER) AS peak_at, CASE WHEN pk < len(v) THEN CAST(list_position(v[pk + 1:], list_max(v[pk + 1:])) + pk - 1 AS INTEGER) END AS second_at FROM o"
)
def onset_picks(spark, sf_dir):
    """Where an array first reaches half its peak, its peak, and the largest arrival after it."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    p = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("peak", F.array_max("v")).withColumn("at", F.array_position("v", F.col("peak")).cast("int"))
    onset = F.array_position(F.transform("v", lambda x: x >= 0.5 * F.col("peak")), True) - 1
    rest = F.slice("v", F.col("at") + 1, F.size("v"))
    second = F.when(F.col("at") < F.size("v"), (F.array_position(rest, F.array_max(rest)) + F.col("at") - 1).cast("int"))
    return p.select("vec_id", onset.cast("int").alias("onset"), (F.col("at") - 1).alias("peak_at"), second.alias("second_at"))


@query(
    f"WITH {DETS}, g AS (SELECT node, (t - lag(t) OVER (PARTITION BY node ORDER BY t, seq)) / 1e6 AS gap FROM d) SELECT node, count(gap) AS n, round(60 / avg(gap), 8) AS cadence, round(stddev_pop(gap) / avg(gap), 5) AS cv, CASE WHEN count(gap) < 20 THEN 'unknown' WHEN stddev_pop(gap) / avg(gap) < 0.95 THEN 'steady' ELSE 'irregular' END AS gait FROM g GROUP BY 1"
)
def gait_cadence(spark, sf_dir):
    """Steps a minute and their variation from the times of impacts."""
    from echofold.operators import temporal as W

    g = W.gaps(detections(spark, sf_dir), ["node"], "t", "seq").withColumn("gap", F.col("gap") / 1e6)
    out = g.groupBy("node").agg(F.count("gap").alias("n"), (60 / F.avg("gap")).alias("cadence"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))
    kind = F.when(F.col("n") < 20, "unknown").when(F.col("cv") < 0.95, "steady").otherwise("irregular")
    return out.select("node", "n", F.round("cadence", 8).alias("cadence"), F.round("cv", 5).alias("cv"), kind.alias("gait"))


GROUNDS = {"snow": 20.0, "grass": 200.0, "soil": 2000.0, "asphalt": 20000.0}


def _impedance(sigma: str) -> tuple[str, str]:
    return f"(1 + 9.08 * pow(1000 * f / ({sigma} * 1000), -0.75))", f"(11.9 * pow(1000 * f / ({sigma} * 1000), -0.73))"


@query(
    f"WITH p AS (SELECT p_partkey AS k, 100.0 + p_size * 20 AS f, 20.0 * pow(10.0, p_partkey % 31 / 10.0) AS sigma FROM part), z AS (SELECT k, f, {_impedance('sigma')[0]} AS re, {_impedance('sigma')[1]} AS im FROM p), g(name, s) AS (VALUES {', '.join(f'({n!r}, {s})' for n, s in GROUNDS.items())}) "
    f"SELECT k, round(re, 5) AS re, round(im, 5) AS im, name AS ground FROM z, g QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(abs(ln(re / {_impedance('s')[0]})) + abs(ln(im / {_impedance('s')[1]})), 9), name) = 1"
)
def ground_classes(spark, sf_dir):
    """Impedance of a porous ground by its flow resistivity, and the named ground that is nearest to it."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "100.0D + p_size * 20 AS f", "20.0D * pow(10.0D, p_partkey % 31 / 10.0D) AS sigma")
    z = p.selectExpr("k", "f", f"{_impedance('sigma')[0]} AS re", f"{_impedance('sigma')[1]} AS im")
    near = F.array_min(F.array(*[F.struct(F.round(F.expr(f"abs(ln(re / {_impedance(f'{s}D')[0]})) + abs(ln(im / {_impedance(f'{s}D')[1]}))"), 9).alias("off"), F.lit(n).alias("name")) for n, s in GROUNDS.items()]))
    return z.select("k", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"), near["name"].alias("ground"))
