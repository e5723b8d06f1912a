"""Table functions called from SQL, functions by name, and decorrelation, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.functions import table_functions as T
from echofold.operators import decorrelation as D
from echofold.plans.tables import detections, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _view(rows, name: str) -> str:
    rows.createOrReplaceTempView(name)
    T.register_table_functions(rows.sparkSession)
    return name


@query(
    "WITH l AS (SELECT event_type AS tenant, CAST(event_id AS VARCHAR) AS record_id, epoch_us(ts) / 1e6 AS next_attempt_at FROM events) SELECT tenant, record_id, next_attempt_at, row_number() OVER (PARTITION BY tenant ORDER BY next_attempt_at, record_id) AS place "
    "FROM l WHERE next_attempt_at <= (SELECT min(next_attempt_at) + 864000 FROM l) QUALIFY place <= 25"
)
def claims_by_tenant(spark, sf_dir):
    """The 25 oldest due rows of each tenant, by a table function."""
    d = detections(spark, sf_dir).select(F.col("source").alias("tenant"), F.col("seq").cast("string").alias("record_id"), (F.col("t") / 1e6).alias("next_attempt_at"))
    first = d.agg(F.min("next_attempt_at")).first()[0]
    view = _view(d, "echofold_ledger")
    return spark.sql(f"SELECT * FROM claim_pending(TABLE({view}) PARTITION BY (tenant) ORDER BY (next_attempt_at, record_id), 25, {(first or 0.0) + 864000!r}D)")


@query(
    "WITH r AS (SELECT CAST(o_orderdate AS VARCHAR)[1:10] AS day, o_orderstatus = 'F' AS finished, epoch(CAST(o_orderdate AS TIMESTAMP)) AS received_at FROM orders) SELECT day, count(*) AS n, count(*) FILTER (NOT finished) AS n_unfinished, "
    "CASE WHEN bool_or(NOT finished) THEN 'unfinished_rows' WHEN max(received_at) >= epoch(TIMESTAMP '1995-06-01') THEN 'within_horizon' ELSE 'drop' END AS verdict FROM r GROUP BY 1"
)
def retention_by_day(spark, sf_dir):
    """What happens to each day's partition, by a table function."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderstatus") == "F").alias("finished"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))").cast("double").alias("received_at"))
    view = _view(o, "echofold_partitions")
    return spark.sql(f"SELECT * FROM enforce_retention(TABLE({view}) PARTITION BY (day), 801964800.0D)")


@query(
    "WITH b AS (SELECT lang AS tenant, CAST(doc_id AS VARCHAR) AS record_id, text AS body, CASE WHEN doc_id % 41 = 7 THEN sha256(text || 'x') WHEN doc_id % 43 = 9 THEN NULL ELSE sha256(text) END AS stated FROM documents) "
    "SELECT tenant, record_id, stated, sha256(body) AS actual FROM b WHERE stated IS NULL OR stated <> sha256(body)"
)
def payloads_that_differ(spark, sf_dir):
    """Documents whose stated digest isn't theirs, by a table function."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    stated = F.when(F.col("doc_id") % 41 == 7, sha(F.concat("text", F.lit("x")))).when(F.col("doc_id") % 43 == 9, F.lit(None)).otherwise(sha(F.col("text")))
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("tenant"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("body"), stated.alias("sha256"))
    # A record is judged by itself, so a tenant's records needn't be in one task.
    return spark.sql(f"SELECT * FROM verify_payload_integrity(TABLE({_view(d, 'echofold_payloads')}) PARTITION BY (tenant, record_id))")


@query("SELECT CAST(user_id % 7 AS VARCHAR) AS tenant, event_type AS class, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1, 2")
def unrouted_classes(spark, sf_dir):
    """Rows of classes that nobody takes, by a table function."""
    d = detections(spark, sf_dir).select((F.col("node") % 7).cast("string").alias("tenant"), F.col("source").alias("class"))
    return spark.sql(f"SELECT * FROM unrouted_records(TABLE({_view(d, 'echofold_records')}) PARTITION BY (tenant), 'click,view')")


@query(
    "WITH p AS (SELECT l_orderkey AS event, 0.05 + l_linenumber / 10.0 + l_suppkey % 10 / 100.0 AS p FROM lineitem), q AS (SELECT event, p, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS x FROM p) "
    "SELECT event, count(*) AS n, round(1 / (1 + exp(-avg(x))), 6) AS by_logodds, round(avg(p), 6) AS by_mean FROM q GROUP BY 1"
)
def fused_by_name(spark, sf_dir):
    """Scores of several receivers fused by the functions of two names."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), (F.lit(0.05) + F.col("l_linenumber") / 10.0 + F.col("l_suppkey") % 10 / 100.0).cast("double").alias("p"))
    both = [T.fused(p, "event", "p", how).select("event", "n", F.round("p", 6).alias(name)) for how, name in (("logodds", "by_logodds"), ("linear", "by_mean"))]
    return both[0].join(both[1].drop("n"), "event")


_LAGS = """WITH e AS (SELECT label AS g, 1000.0 + vec_id * 60 + vec_id * 7919 % 13 AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v0, vec_id FROM embeddings),
w AS (SELECT g, t, list_transform(v0, lambda x, k: x + CASE WHEN (g + k) % 4 = 0 THEN 0.6 * sin(t / (2000.0 + 800 * g)) ELSE 0 END) AS v FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) - 1 AS i, t - lag(t) OVER (PARTITION BY g ORDER BY t) AS gap FROM w),
f AS (SELECT g, count(*) AS n, max(t) - min(t) AS span, median(gap) FILTER (gap > 0) AS dt FROM r GROUP BY 1), c AS (SELECT *, span / 4 AS cap, least(CAST(floor(span / 4 / dt) AS BIGINT), n - 2) AS most FROM f),
k AS (SELECT DISTINCT g, dt, CAST(CASE j WHEN 0 THEN 1 WHEN 47 THEN most ELSE round_even(exp(ln(most) * j / 47), 0) END AS BIGINT) AS k FROM c, (SELECT unnest(range(0, 48)) AS j)),
x AS (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM r), m AS (SELECT g, list(m ORDER BY j) AS m FROM (SELECT g, j, avg(x) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT r.g, i, t, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS z FROM r JOIN m USING (g)), y AS (SELECT *, sqrt(list_dot_product(z, z)) AS norm FROM z), l AS (SELECT *, norm - avg(norm) OVER (PARTITION BY g) AS lev, var_pop(norm) OVER (PARTITION BY g) AS spread FROM y),
p AS (SELECT a.g, k.k, b.t - a.t AS sep, list_dot_product(a.z, b.z) / (a.norm * b.norm) AS cos, a.lev * b.lev AS ll, a.spread FROM l a JOIN k ON k.g = a.g JOIN l b ON b.g = a.g AND b.i = a.i + k.k WHERE a.norm > 0 AND b.norm > 0 AND b.t - a.t BETWEEN 0.5 * k.k * k.dt AND 1.5 * k.k * k.dt),
q AS (SELECT g, k, count(*) AS n_pairs, avg(cos) AS direction, CASE WHEN any_value(spread) > 0 THEN avg(ll) / any_value(spread) ELSE 0 END AS level, median(sep) AS lag_s FROM p GROUP BY 1, 2 HAVING count(*) >= 8),
o AS (SELECT *, greatest(direction, level) AS statistic, row_number() OVER (PARTITION BY g ORDER BY k) AS place FROM q), h AS (SELECT g, coalesce(max(place) FILTER (round(statistic, 9) >= 0.5), 0) AS above, max(place) AS "end" FROM o GROUP BY 1)
SELECT c.g AS label, c.n, round(CASE WHEN h.above >= h."end" THEN c.cap ELSE o.lag_s END, 4) AS lag_s, CASE WHEN h.above >= h."end" THEN c.most ELSE o.k END AS lag_rows, o.n_pairs, round(o.statistic, 6) AS statistic, CASE WHEN u.level >= u.direction THEN 'level' WHEN u.level < u.direction THEN 'direction' END AS channel, h.above >= h."end" AS censored,
 CASE WHEN h.above >= h."end" THEN 'censored_lag' WHEN floor(c.span / (3 * o.lag_s)) + 1 < 7 THEN 'too_few_blocks' ELSE 'pass' END AS gate FROM c JOIN h ON h.g = c.g LEFT JOIN o ON o.g = h.g AND o.place = h.above + 1 LEFT JOIN o u ON u.g = h.g AND u.place = h.above"""


@query(_LAGS)
def decorrelation_gates(spark, sf_dir):
    """How long each class's vectors, with a slow swing on some axes, stay alike, and whether blocks can be sized by it."""
    label, vec = F.col("label"), F.col("vec_id")
    t = 1000.0 + vec * 60 + vec * 7919 % 13
    swing = lambda k: F.when((label + k + 1) % 4 == 0, 0.6 * F.sin(t / (2000.0 + 800 * label))).otherwise(0.0)
    e = table(spark, sf_dir, "embeddings").select("label", t.alias("t"), F.transform("embedding", lambda x, k: x.cast("double") + swing(k)).alias("v"))
    lags = D.decorrelation(e, "label", "t", "v")
    spans = e.groupBy("label").agg((F.max("t") - F.min("t")).alias("span_s"))
    gates = D.block_gates(lags, spans, "label")
    return gates.select("label", "n", F.round("lag_s", 4).alias("lag_s"), "lag_rows", "n_pairs", F.round("statistic", 6).alias("statistic"), "channel", "censored", "gate")
