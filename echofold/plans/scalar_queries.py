"""Queries on formulas and small codecs, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.functions import acoustics as A
from echofold.plans.tables import DETS, HOUR, detections, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(
    "WITH p AS (SELECT p_partkey AS k, p_size * 10.0 AS r, CAST(p_size % 60 AS DOUBLE) AS th, 345.238 AS c, 1.2 + p_size % 10 * 0.2 AS m FROM part), i AS (SELECT *, CASE WHEN radians(th) < acos(1 / m) THEN r / c * (1 - cos(radians(th) - acos(1 / m))) END AS dt FROM p) "
    "SELECT k, round(dt, 8) AS dt, round(CASE WHEN 1 - cos(radians(th) - acos(1 / m)) > 1e-9 THEN c * dt / (1 - cos(radians(th) - acos(1 / m))) END, 4) AS range_m, round(c * dt / (1 - 1 / m), 4) AS at_least_m, "
    "round(CASE WHEN 1 - c * dt / r BETWEEN -1 AND 1 AND asin(1 - c * dt / r) - asin(1 / m) >= -1e-9 THEN degrees(asin(1 - c * dt / r) - asin(1 / m)) END, 3) AS theta_deg FROM i"
)
def crack_blast(spark, sf_dir):
    """Interval between crack and blast, and back from it to range and angle."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size * 10.0D AS r", "CAST(p_size % 60 AS DOUBLE) AS th", "345.238D AS c", "1.2D + p_size % 10 * 0.2D AS m")
    i = p.withColumn("dt", A.crack_blast_interval(F.col("r"), F.col("th"), F.col("c"), F.col("m")))
    c, m, dt = F.col("c"), F.col("m"), F.col("dt")
    return i.select("k", F.round("dt", 8).alias("dt"), F.round(A.range_from_interval(dt, F.col("th"), c, m), 4).alias("range_m"), F.round(A.range_lower_bound(dt, c, m), 4).alias("at_least_m"), F.round(A.theta_from_interval(dt, F.col("r"), c, m), 3).alias("theta_deg"))


@query(
    "SELECT p_partkey AS k, round(p_size * 0.001 * 343.0, 6) AS delta_m, round(CASE WHEN abs(p_size * 0.001 * 343.0) <= 12.0 THEN degrees(acos(p_size * 0.001 * 343.0 / 12.0)) END, 5) AS asymptote, round(degrees(abs(atan2((0.0 - p_size) * -7.0 - (-7.0) * (12.0 - p_size), (0.0 - p_size) * (12.0 - p_size) + 49.0))), 5) AS subtended, "
    "round(pow(343.0 * 0.0001, 2) + pow(p_size * 0.001 * 0.6, 2), 9) AS variance_m2 FROM part"
)
def range_differences(spark, sf_dir):
    tau, zero = F.col("p_size") * 0.001, F.lit(0.0)
    delta = A.range_difference(tau, F.lit(343.0))
    x = F.col("p_size").cast("double")
    subtended = A.subtended_angle_deg(zero, zero, F.lit(12.0), zero, x, F.lit(7.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(delta, 6).alias("delta_m"), F.round(A.asymptote_deg(delta, F.lit(12.0)), 5).alias("asymptote"), F.round(subtended, 5).alias("subtended"), F.round(A.tdoa_variance(tau, F.lit(0.0001), F.lit(343.0), F.lit(0.6)), 9).alias("variance_m2"))


def _ecef(la: str, lo: str, h: str) -> list[str]:
    n = f"(6378137.0 / sqrt(1 - 0.0066943799901413165 * sin({la}) * sin({la})))"
    return [f"(({n} + {h}) * cos({la}) * cos({lo}))", f"(({n} + {h}) * cos({la}) * sin({lo}))", f"(({n} * (1 - 0.0066943799901413165) + {h}) * sin({la}))"]


_P, _O = _ecef("la", "lo", "h"), _ecef("radians(48.0)", "radians(11.0)", "500.0")
_D = [f"({p} - {o})" for p, o in zip(_P, _O)]
_SLA, _CLA, _SLO, _CLO = "sin(radians(48.0))", "cos(radians(48.0))", "sin(radians(11.0))", "cos(radians(11.0))"
ENU = [f"(-{_SLO} * {_D[0]} + {_CLO} * {_D[1]})", f"(-{_SLA} * {_CLO} * {_D[0]} - {_SLA} * {_SLO} * {_D[1]} + {_CLA} * {_D[2]})", f"({_CLA} * {_CLO} * {_D[0]} + {_CLA} * {_SLO} * {_D[1]} + {_SLA} * {_D[2]})"]


@query(f"WITH g AS (SELECT n_nationkey AS k, radians(48 + n_nationkey * 0.001) AS la, radians(11 - n_regionkey * 0.002) AS lo, 500.0 + n_nationkey AS h FROM nation) SELECT k, round({ENU[0]}, 3) AS e, round({ENU[1]}, 3) AS n, round({ENU[2]}, 3) AS u FROM g")
def geodetic_to_enu(spark, sf_dir):
    e, n, u = A.enu(48 + F.col("n_nationkey") * 0.001, 11 - F.col("n_regionkey") * 0.002, 500.0 + F.col("n_nationkey"), (48.0, 11.0, 500.0))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.round(e, 3).alias("e"), F.round(n, 3).alias("n"), F.round(u, 3).alias("u"))


@query(
    "WITH s AS (SELECT o_orderkey AS k, o_orderkey % 1000 * 10.0 - 5000 AS e, o_custkey % 700 * 10.0 - 3000 AS n, 1000.0 AS u, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_orderkey % 200 - 100.0 END AS ve, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_custkey % 150 - 75.0 END AS vn FROM orders), "
    "t AS (SELECT *, CASE WHEN ve * ve + vn * vn > 0 THEN -(e * ve + n * vn) / (ve * ve + vn * vn) ELSE 0.0 END AS t FROM s) SELECT k, round(t, 6) AS t_s, round(sqrt(pow(e + ve * t, 2) + pow(n + vn * t, 2) + u * u), 4) AS range_m, round(sqrt(e*e + n*n + u*u) / 343.42, 6) AS delay_s, "
    "round(((degrees(atan2(e, n)) % 360) + 360) % 360, 4) AS azimuth, round(degrees(atan2(u, sqrt(e*e + n*n))), 4) AS elevation, round(440.0 / (1 + (e * ve + n * vn) / sqrt(e*e + n*n + u*u) / 343.42), 4) AS heard_hz FROM t"
)
def aircraft_tracks(spark, sf_dir):
    """Closest approach, delay, direction and Doppler shift of straight tracks."""
    s = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey % 1000 * 10.0D - 5000 AS e", "o_custkey % 700 * 10.0D - 3000 AS n", "1000.0D AS u", "if(o_orderkey % 11 = 0, 0.0D, o_orderkey % 200 - 100.0D) AS ve", "if(o_orderkey % 11 = 0, 0.0D, o_custkey % 150 - 75.0D) AS vn"
    )
    p, v = [F.col(c) for c in "enu"], [F.col("ve"), F.col("vn"), F.lit(0.0)]
    t, near = A.closest_approach(p, v)
    r, azimuth, elevation = A.bearing_elevation(*p)
    heard = A.doppler_hz(F.lit(440.0), p, v, F.lit(343.42))
    return s.select("k", F.round(t, 6).alias("t_s"), F.round(near, 4).alias("range_m"), F.round(r / 343.42, 6).alias("delay_s"), F.round(azimuth, 4).alias("azimuth"), F.round(elevation, 4).alias("elevation"), F.round(heard, 4).alias("heard_hz"))


_K, _H = "(p_size - 10 + 273.15)", "h"


@query(
    f"WITH h AS (SELECT p_partkey AS k, p_size, p_size * CAST(100 AS DOUBLE) AS f, CAST(50 AS DOUBLE) * 101.325 * pow(10.0, -6.8346 * pow(273.16 / {_K}, 1.261) + 4.6151) / 98.0 AS h FROM part), "
    f"r AS (SELECT *, 98.0 / 101.325 * (24.0 + 4.04e4 * h * (0.02 + h) / (0.391 + h)) AS o, 98.0 / 101.325 * sqrt(293.15 / {_K}) * (9.0 + 280.0 * h * exp(-4.17 * (pow(293.15 / {_K}, 1.0 / 3) - 1))) AS n FROM h) "
    f"SELECT k, round(8.685889638 * f * f * (1.84e-11 / (98.0 / 101.325) * sqrt({_K} / 293.15) + pow({_K} / 293.15, -2.5) * (0.01275 * exp(-2239.1 / {_K}) / (o + f * f / o) + 0.1068 * exp(-3352.0 / {_K}) / (n + f * f / n))), 8) AS db_m FROM r"
)
def air_attenuation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), F.round(A.attenuation_db_m(F.col("p_size") * 100.0, F.col("p_size") - 10.0, F.lit(50.0), F.lit(98.0)), 8).alias("db_m"))


@query(
    "WITH f AS (SELECT DISTINCT p_size * 800.0 AS fs FROM part), m AS (SELECT fs, 2595 * log10(1 + 100.0 / 700) AS lo, 2595 * log10(1 + least(8000.0, fs / 2 * 0.98) / 700) AS hi, 2595 * log10(1 + 8000.0 / 700) AS top FROM f), "
    "e AS (SELECT fs, list_transform(range(0, 18), lambda k: 700 * (pow(10, (lo + k * (hi - lo) / 17) / 2595) - 1)) AS edges, list_transform(range(0, 18), lambda k: 700 * (pow(10, (lo + k * (top - lo) / 17) / 2595) - 1)) AS fixed FROM m) "
    "SELECT fs, list_transform(edges, lambda x: round(x, 4)) AS edges, CAST(len(list_filter(fixed[1:16], lambda x: x < fs / 2)) AS INTEGER) AS n_valid, CAST(len(list_filter(fixed[3:18], lambda x: x <= fs / 2)) AS INTEGER) AS n_whole FROM e"
)
def mel_bands(spark, sf_dir):
    """Edges of bands that follow the rate, and how many of fixed ones a rate can carry."""
    f = table(spark, sf_dir, "part").select((F.col("p_size") * 800.0).alias("fs")).distinct()
    fs = F.col("fs")
    fixed = A.band_edges_hz(fs, 16, 100.0, 8000.0, True)
    return f.select("fs", F.transform(A.band_edges_hz(fs, 16, 100.0, 8000.0, False), lambda x: F.round(x, 4)).alias("edges"), A.valid_bands(fixed, fs).alias("n_valid"), A.valid_bands(fixed, fs, True).alias("n_whole"))


@query(
    f"WITH {DETS}, r AS (SELECT seq, t / 1000000.0 AS ref, (t + (seq % 5 - 2) * 30000000000) % 86400000000 AS us FROM d), u AS (SELECT seq, ref, floor(ref / 86400) * 86400 + us / 1e6 AS x FROM r) SELECT seq, round(CASE WHEN x - ref > 43200 THEN x - 86400 WHEN ref - x > 43200 THEN x + 86400 ELSE x END, 3) AS utc_s FROM u"
)
def unwrapped_times(spark, sf_dir):
    """Times of day brought to the day that is nearest to when they were received."""
    d = detections(spark, sf_dir)
    us = (F.col("t") + (F.col("seq") % 5 - 2) * 30000000000) % 86400000000
    return d.select("seq", F.round(A.unwrapped_utc(us, F.col("t") / 1000000.0), 3).alias("utc_s"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, v, list_sum(v) / len(v) AS mean, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS rms FROM v), "
    "m AS (SELECT vec_id, v, rms, list_sum(list_transform(v, lambda x: pow(x - mean, 2))) / len(v) AS m2, list_sum(list_transform(v, lambda x: pow(x - mean, 4))) / len(v) AS m4 FROM s) "
    "SELECT vec_id, round(20 * log10(rms), 4) AS dbfs, round(list_max(list_transform(v, lambda x: abs(x))) / rms, 4) AS crest, round(m4 / (m2 * m2) - 3, 4) AS kurtosis, round(1 / (1 + exp(-greatest(-60.0, least(60.0, v[1] * 2.0 - v[2] * 3.0 + 0.5)))), 5) AS p FROM m"
)
def array_measures(spark, sf_dir):
    """Level, crest factor and kurtosis of arrays, and a linear model's probability."""
    e = F.col("embedding")
    two = A.logistic_score(F.slice(e, 1, 2), F.array(F.lit(2.0), F.lit(-3.0)), 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.dbfs(e), 4).alias("dbfs"), F.round(A.crest_factor(e), 4).alias("crest"), F.round(A.kurtosis(e), 4).alias("kurtosis"), F.round(two, 5).alias("p"))


_NAMES = "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN '/clips/../x.wav' WHEN event_id % 7 = 2 THEN '/other/n1-ab-1.wav' WHEN event_id % 7 = 3 THEN '/clips/a/b.wav' WHEN event_id % 7 = 4 THEN '/clips/node{n}-ab{k}-00{k}.wav' WHEN event_id % 7 = 5 THEN '/clips/07-node{n}-ab{k}-{k}.wav' ELSE ' /clips/node{n}_{k}.wav' END"


@query(
    f"WITH n AS (SELECT event_id, user_id, event_id % 7 AS r FROM events) SELECT event_id, CASE WHEN r IN (4, 5) THEN 'node' || user_id END AS node, CASE WHEN r IN (4, 5) THEN 'ab' || event_id END AS boot, CASE WHEN r IN (4, 5) THEN event_id END AS sample, CASE WHEN r = 5 THEN 7 END AS prio, "
    "CASE r WHEN 0 THEN 'empty' WHEN 1 THEN 'dots' WHEN 2 THEN 'outside' WHEN 3 THEN 'nested' WHEN 6 THEN 'pattern' END AS reason FROM n"
)
def clip_names(spark, sf_dir):
    """Parts of a clip's path, or the first thing wrong with it."""
    e = table(spark, sf_dir, "events")
    name = F.replace(F.replace(F.expr(_NAMES), F.lit("{n}"), F.col("user_id").cast("string")), F.lit("{k}"), F.col("event_id").cast("string"))
    return e.select("event_id", A.clip_name(name).alias("c")).select("event_id", "c.*")


@query(
    "WITH c AS (SELECT o_orderkey AS k, o_orderkey % 5 AS i, CAST(floor(o_totalprice) AS BIGINT) AS total FROM orders) SELECT k, CAST(ceil(total / 65536.0) AS BIGINT) AS n_chunks, CASE WHEN i * 65536 < total THEN i * 65536 END AS first, CASE WHEN i * 65536 < total THEN least((i + 1) * 65536, total) END AS last FROM c"
)
def upload_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("i"), F.floor("o_totalprice").cast("long").alias("total"))
    return c.select("k", F.ceil(F.col("total") / 65536).alias("n_chunks"), A.chunk_span(F.col("i"), F.col("total"), 65536).alias("s")).select("k", "n_chunks", "s.first", "s.last")


@query(
    f"WITH {DETS} SELECT seq, strftime(make_timestamp(t), '%Y-%m-%d') AS day, range(t // 86400000000, (t + {30 * HOUR}) // 86400000000 + 1) AS days, CAST(isodow(make_timestamp(t)) AS INTEGER) AS weekday, strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM d"
)
def utc_days(spark, sf_dir):
    """The partition of a time, the days that an interval touches, and its text."""
    at = F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=F.floor(F.col("t") / 1000000).cast("decimal(18,6)"))
    d = detections(spark, sf_dir)
    return d.select("seq", A.day_partition(F.col("t")).alias("day"), A.days_touched(F.col("t"), F.col("t") + 30 * HOUR).alias("days"), (F.weekday(at) + 1).alias("weekday"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query(
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.gone') IS NULL AS is_missing, left(sha256('{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}'), 32) AS canonical FROM events"
)
def canonical_json(spark, sf_dir):
    """A body's fields by path, and a digest of its canonical form: keys in order, no spaces."""
    v = F.try_parse_json("props")
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.try_variant_get(v, "$.k", "int").alias("k"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.gone", "int").isNull().alias("is_missing"), F.left(F.sha2(text, 256), F.lit(32)).alias("canonical"))


_KINDS = {"bird": "animal", "engine": "vehicle", "rain": "weather", "speech": "human"}


@query(
    "WITH s AS (SELECT vec_id, round(CAST(unnest(embedding) AS DOUBLE), 6) AS s, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k DESC) = 1) "
    "SELECT vec_id, ['bird', 'engine', 'rain', 'speech'][k % 4 + 1] || '/' || k AS top, ['animal', 'vehicle', 'weather', 'human'][k % 4 + 1] AS family FROM t"
)
def class_families(spark, sf_dir):
    """The best scored of all classes of each vector, and the family that the first part of its name belongs to."""
    family = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    best = F.array_max(F.transform("embedding", lambda x, k: F.struct(F.round(x.cast("double"), 6).alias("s"), k.alias("k"))))
    name = F.concat_ws("/", F.get(F.array(*[F.lit(n) for n in _KINDS]), F.col("k") % 4), F.col("k").cast("string"))
    top = table(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", best["k"].alias("k")).select("vec_id", name.alias("top"))
    return top.select("vec_id", "top", F.element_at(family, F.split("top", "/")[0]).alias("family"))


@query(
    f"WITH {DETS}, s AS (SELECT t // {HOUR} * 3600 AS shard, node, seq, t FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY t, node, seq) AS rn FROM s) SELECT shard, count(*) AS n, min(t) AS t_from, max(t) AS t_to, arg_min(seq, rn) AS first_seq FROM r GROUP BY 1"
)
def hourly_shards(spark, sf_dir):
    """Shards by the event's hour, each in order of time."""
    s = detections(spark, sf_dir).withColumn("shard", F.floor(F.col("t") / HOUR) * 3600)
    first = F.min_by("seq", F.struct("t", "node", "seq"))
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min("t").alias("t_from"), F.max("t").alias("t_to"), first.alias("first_seq"))


@query(
    "WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (value <= 5) AS a, count(*) FILTER (value <= 50) AS b FROM events GROUP BY 1) "
    "SELECT 'rows_total{type=\"' || event_type || '\"} ' || n AS line FROM c UNION ALL SELECT 'value_bucket{type=\"' || event_type || '\",le=\"5\"} ' || a FROM c UNION ALL SELECT 'value_bucket{type=\"' || event_type || '\",le=\"50\"} ' || b FROM c UNION ALL SELECT 'value_bucket{type=\"' || event_type || '\",le=\"+Inf\"} ' || n FROM c"
)
def metric_lines(spark, sf_dir):
    """Counters and cumulative buckets as lines of text, labels in a fixed order."""
    v = F.col("value")
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v <= 5).alias("a"), F.count_if(v <= 50).alias("b"))
    label = F.concat(F.lit('{type="'), F.col("event_type"))

    def line(name: str, le: str | None, value: str):
        return F.concat(F.lit(name), label, F.lit('"} ' if le is None else f'",le="{le}"}} '), F.col(value).cast("string"))

    return c.select(F.explode(F.array(line("rows_total", None, "n"), line("value_bucket", "5", "a"), line("value_bucket", "50", "b"), line("value_bucket", "+Inf", "n"))).alias("line"))


@query(
    "SELECT n_nationkey AS k, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || n_regionkey * 10 || ',' || n_nationkey || ']},\"properties\":{\"name\":\"' || n_name || '\"}}' AS feature FROM nation"
)
def geo_features(spark, sf_dir):
    """One feature a line, as text."""
    n = table(spark, sf_dir, "nation")
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col("n_regionkey") * 10, F.col("n_nationkey")).alias("coordinates")).alias("geometry"), F.struct(F.col("n_name").alias("name")).alias("properties"))
    return n.select(F.col("n_nationkey").alias("k"), F.to_json(f).alias("feature"))


@query(
    "WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'pending' ELSE 'dead_letter' END AS state FROM events), p AS (SELECT *, lag(state, 1, 'new') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM t) "
    "SELECT before, state, count(*) AS n, before || '>' || state IN ('new>pending', 'pending>claimed', 'claimed>published', 'claimed>pending', 'claimed>dead_letter') AS allowed FROM p GROUP BY 1, 2"
)
def outbox_transitions(spark, sf_dir):
    """How often each step of an outbox occurs, and whether it may."""
    state = F.expr("CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'pending' ELSE 'dead_letter' END")
    before = F.lag("state", 1, "new").over(Window.partitionBy("user_id").orderBy("event_id"))
    p = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state")).withColumn("before", before)
    steps = ("new>pending", "pending>claimed", "claimed>published", "claimed>pending", "claimed>dead_letter")
    return p.groupBy("before", "state").agg(F.count("*").alias("n")).withColumn("allowed", F.concat("before", F.lit(">"), "state").isin(*steps))


@query(
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v) "
    "SELECT vec_id, CASE WHEN norm > 0 AND len(v) = 64 THEN list_transform(v, lambda x: round(x / norm, 5)) END AS vector, CASE WHEN len(v) <> 64 THEN 'wrong_size' WHEN norm = 0 THEN 'no_direction' END AS rejection FROM n"
)
def embed_records(spark, sf_dir):
    """One vector of length one or one rejection for each row."""
    e = F.col("embedding")
    rejection = F.when(F.size(e) != 64, "wrong_size").when(A.dot(e, e) == 0, "no_direction")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(rejection.isNull(), F.transform(A.l2_normalised(e), lambda x: A.rounded(x, 5))).alias("vector"), rejection.alias("rejection"))
