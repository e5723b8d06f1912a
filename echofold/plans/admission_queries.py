"""Queries on admission, each with the SQL that it must agree with. Attributes that the driver tables lack are arithmetic on keys, the same text in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.operators import admission as A
from echofold.operators import classify as C
from echofold.plans.tables import DETS, detections, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: The producer's statements about a detection, from its number.
STATED = {
    "key": "seq",
    "node": "node",
    "source": "CASE WHEN seq % 9 = 0 THEN 'phone' ELSE 'node' END",
    "ts": "CASE WHEN seq % 53 = 1 THEN NULL ELSE t / 1000000.0 END",
    "parsed": "seq % 97 <> 5",
    "clock_tier": "CASE WHEN seq % 18 = 0 THEN 'gnss' WHEN seq % 27 = 9 THEN 'ntp' END",
    "onset_dated": "CASE WHEN seq % 63 = 0 THEN false END",
    "utc_trusted": "CASE WHEN seq % 36 = 27 THEN true END",
    "clock_state": "CASE WHEN seq % 31 = 3 THEN ' locked' WHEN seq % 31 = 4 THEN 'FREE' WHEN seq % 31 = 5 THEN '' END",
    "sync_sigma_ns": "CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(seq % 131 * 1000.0 AS DOUBLE) END",
    "onset_found": "CASE WHEN seq % 37 = 2 THEN false WHEN seq % 2 = 0 THEN true END",
    "latency_ns": "CASE WHEN seq % 2 = 0 THEN CAST(5.0 AS DOUBLE) END",
}
SURVEY = {"node": "node", "class": "CASE WHEN node % 10 = 3 THEN 'other' WHEN node % 10 = 4 THEN 'reference' WHEN node % 10 = 5 THEN 'phone' WHEN node % 10 = 6 THEN 'quiet' END", "arrives": "node % 10 <> 6"}
CLASSES = [(None, 50e-6, "pps", 60e-6), ("reference", 40e-6, "pps", 10e-6), ("other", 50e-6, "none", None), ("phone", 20e-6, "gnss", 20e-6)]
NOW, SINCE, UNTIL = 1706000000.0, 1704240000.0, 1705990000.0
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in c) + ")" for c in CLASSES)
ADMISSION_SQL = (
    f"WITH {DETS}, s AS (SELECT {', '.join(f'{e} AS {n}' for n, e in STATED.items())} FROM d), v AS (SELECT {', '.join(f'{e} AS {n}' for n, e in SURVEY.items())} FROM (SELECT DISTINCT node FROM d WHERE node % 10 <> 7)), "
    f"l(cls, capture_s, time_source, bias_s) AS (VALUES {_VALUES}), "
    "j AS (SELECT s.*, v.node IS NOT NULL AS surveyed, v.class AS stated, v.arrives, coalesce(v.class, CASE WHEN s.source = 'phone' THEN 'phone' END) AS cls, "
    "CASE WHEN s.source = 'phone' THEN CASE WHEN onset_dated = false THEN false WHEN utc_trusted IS NOT NULL THEN utc_trusted ELSE clock_tier IN ('gnss', 'location') END END AS trusted FROM s LEFT JOIN v ON s.node = v.node), "
    "k AS (SELECT j.*, l.capture_s, l.time_source, l.bias_s FROM j LEFT JOIN l ON j.cls IS NOT DISTINCT FROM l.cls), "
    f"c AS (SELECT key, node, source, trusted, CASE WHEN NOT parsed THEN 'line_unparseable' WHEN ts IS NULL THEN 'unanchored' WHEN ts < {SINCE} OR ts > {UNTIL} THEN 'outside_window' WHEN ts > {NOW} - 86400 THEN 'pending_settle' "
    f"WHEN ts < {NOW} - 1700000 AND key % 5 = 0 THEN 'outside_lookback_emitted' WHEN ts < {NOW} - 1700000 THEN 'outside_lookback_unassociated' WHEN surveyed AND NOT arrives THEN 'not_arrival_class' WHEN NOT surveyed THEN 'unsurveyed_node' "
    "WHEN (source = 'phone' AND key % 2 = 1) OR stated = 'other' AND false THEN 'x' "
    "WHEN source = 'phone' AND trusted IS NULL THEN 'clock_unstated' WHEN trusted = false THEN 'clock_untrusted' WHEN upper(trim(coalesce(clock_state, ''))) NOT IN ('', 'LOCKED', 'HOLDOVER') THEN 'clock_state_inadmissible' "
    "WHEN sync_sigma_ns > 125000 THEN 'sync_sigma_exceeds' WHEN sync_sigma_ns IS NOT NULL AND (coalesce(time_source, '') = 'none' OR sqrt(capture_s * capture_s + pow(sync_sigma_ns / 1e9, 2)) > 129.4e-6) THEN 'stamp_sigma_over_class_budget' "
    "WHEN bias_s IS NULL OR bias_s > 62.5e-6 THEN 'capture_path_bias' WHEN onset_found = false THEN 'onset_not_found' WHEN onset_found IS NULL AND key % 1 = 1 THEN 'onset_unstated' WHEN source = 'phone' AND latency_ns IS NULL THEN 'latency_uncorrected' ELSE 'admitted' END AS reason FROM k) "
)


def _sql(heterogeneous: bool, refuse_onset: bool) -> str:
    out = ADMISSION_SQL.replace("WHEN (source = 'phone' AND key % 2 = 1) OR stated = 'other' AND false THEN 'x' ", "" if heterogeneous else "WHEN source = 'phone' OR (stated <> '' AND stated <> 'reference') THEN 'heterogeneous_receiver_class' ")
    return out.replace("key % 1 = 1", "true" if refuse_onset else "false")


def _admitted(spark, sf_dir, heterogeneous: bool, refuse_onset: bool):
    d = detections(spark, sf_dir)
    survey = d.where("node % 10 <> 7").select("node").distinct().selectExpr(*[f"{e} AS {n}" for n, e in SURVEY.items()])
    classes = spark.createDataFrame(CLASSES, "class string, capture_s double, time_source string, bias_s double")
    policy = A.Policy(since=SINCE, until=UNTIL, settle_s=86_400, lookback_s=1_700_000, max_sync_sigma_ns=125_000, heterogeneous=heterogeneous, refuse_onset_unstated=refuse_onset)
    rows = d.selectExpr(*[f"{e} AS {n}" for n, e in STATED.items()])
    return A.admit(rows, survey, classes, d.where("seq % 5 = 0").select(F.col("seq").alias("key")), NOW, policy)


@query(_sql(True, False) + "SELECT key, trusted, reason FROM c")
def admission_all_reasons(spark, sf_dir):
    return _admitted(spark, sf_dir, True, False).select("key", "trusted", "reason")


@query(_sql(False, True) + ", t AS (SELECT reason, count(*) AS n, (SELECT count(*) FROM events) AS n_input FROM c GROUP BY 1) SELECT * FROM t")
def admission_strict_tally(spark, sf_dir):
    """Tallies under the strict policy, beside a count of the input that doesn't pass through the gates."""
    counts = C.tally(_admitted(spark, sf_dir, False, True))
    return counts.join(table(spark, sf_dir, "events").agg(F.count("*").alias("n_input")))


@query(_sql(True, False) + ", n AS (SELECT (SELECT count(*) FROM events) AS n_input, (SELECT count(reason) FROM c) AS n_classified) SELECT *, n_input = n_classified AS closed FROM n")
def admission_conservation(spark, sf_dir):
    """Rows at the source against rows that came out of the joins of admission with a reason."""
    return C.conservation(table(spark, sf_dir, "events"), _admitted(spark, sf_dir, True, False))


@query(
    f"WITH {DETS} SELECT seq, CASE WHEN seq % 6 = 0 THEN CASE WHEN seq % 5 = 0 THEN false WHEN seq % 4 = 0 THEN seq % 8 = 0 WHEN seq % 9 = 0 THEN seq % 18 = 0 END END AS trusted FROM d"
)
def derived_clock_trust(spark, sf_dir):
    d = detections(spark, sf_dir)
    e = F.expr
    return d.select("seq", A.clock_trust(e("if(seq % 6 = 0, 'phone', 'node')"), e("CASE WHEN seq % 9 = 0 THEN if(seq % 18 = 0, 'location', 'ntp') END"), e("if(seq % 5 = 0, false, NULL)"), e("if(seq % 4 = 0, seq % 8 = 0, NULL)")).alias("trusted"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'bias_unmeasured' WHEN p_size * 2e-6 > 62.5e-6 THEN 'bias_too_large' END AS refusal, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 7 = 0 THEN false ELSE sqrt(pow(50e-6, 2) + pow(p_size * 4000 / 1e9, 2)) <= 129.4e-6 END END AS stamp FROM part"
)
def class_gates(spark, sf_dir):
    e = F.expr
    p = table(spark, sf_dir, "part")
    stamp = A.stamp_admissible(e("if(p_size % 3 > 0, p_size * 4000.0, NULL)").cast("double"), F.lit(50e-6), e("if(p_size % 7 = 0, 'none', 'pps')"), 129.4e-6)
    return p.select("p_partkey", A.bias_refusal(e("if(p_size % 5 = 0, NULL, p_size * 2e-6)"), 62.5e-6).alias("refusal"), stamp.alias("stamp"))


@query(
    f"WITH {DETS} SELECT seq, CASE WHEN source = 'click' THEN 'unit-' || (node % 3) WHEN node % 4 = 0 THEN NULL ELSE source END AS node, CASE WHEN source = 'click' THEN 'alias' ELSE 'topic' END AS node_from, CASE WHEN source = 'click' THEN 'raw-' || (node % 3) END AS node_alias_of FROM d"
)
def node_aliases(spark, sf_dir):
    """Declared renames are applied and the raw name stays readable."""
    raw = F.expr("CASE WHEN source = 'click' THEN concat('raw-', node % 3) WHEN node % 4 = 0 THEN NULL ELSE source END")
    aliases = spark.createDataFrame([(f"raw-{k}", f"unit-{k}") for k in range(3)], "alias string, name string")
    rows = detections(spark, sf_dir).select("seq", raw.alias("node"), F.lit("topic").alias("node_from"))
    return A.resolved_identity(rows, aliases).select("seq", "node", "node_from", "node_alias_of")


@query(
    "SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 'frames' WHEN p_size < 12 THEN 'bands_short' WHEN p_size % 7 = 0 THEN 'layout_unstated' WHEN p_size % 5 = 0 THEN 'layout_mismatch' WHEN p_size % 3 = 0 THEN 'fs_mismatch' WHEN p_size % 2 = 0 AND p_size < 24 THEN 'bands_for_rate' END AS refusal FROM part"
)
def score_refusals(spark, sf_dir):
    e = F.expr
    frame = {"frames": e("if(p_size % 4 = 1, 7, 8)"), "bands": F.col("p_size"), "layout": e("if(p_size % 7 = 0, NULL, if(p_size % 5 = 0, 'old', 'fixed'))"), "fs_hz": e("if(p_size % 3 = 0, NULL, 16000D)"), "valid_bands": e("if(p_size % 2 = 0 and p_size < 24, 11, NULL)")}
    return table(spark, sf_dir, "part").select("p_partkey", A.frame_refusal(frame, 12, 8, "fixed", 16000.0, 96).alias("refusal"))


@query(
    "WITH m AS (SELECT l_orderkey AS event, l_linenumber AS node, l_suppkey % 50 * 10.0 AS x, l_partkey % 40 * 10.0 AS y, l_quantity AS z, l_extendedprice / 100000 AS t FROM lineitem), "
    "p AS (SELECT a.event, abs(b.t - a.t) AS dt, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 343.0 AS bound FROM m a JOIN m b ON a.event = b.event AND a.node < b.node) "
    "SELECT event, bool_and(dt <= bound) AS admissible, bool_and(dt <= bound + 0.05) AND NOT bool_and(dt <= bound) AS margin_dependent, count(*) FILTER (dt > bound) AS n_violating, round(max(greatest(0.0, dt - bound) * 343.0), 3) AS worst_excess_m FROM p GROUP BY 1"
)
def point_source_bounds(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS event", "l_linenumber AS node", "l_suppkey % 50 * 10.0D AS x", "l_partkey % 40 * 10.0D AS y", "CAST(l_quantity AS DOUBLE) AS z", "CAST(l_extendedprice AS DOUBLE) / 100000 AS t")
    return A.pair_bound_check(m, 343.0, 0.05).withColumn("worst_excess_m", F.round("worst_excess_m", 3))


@query(
    "SELECT p_partkey, CASE WHEN 100.0 < 343.0 / (2.0 * p_size / 20.0) THEN round(least(p_size * 20.0, 343.0 / (2.0 * p_size / 20.0)), 6) END AS high, CASE WHEN p_size * 400 / 2.0 * 0.95 < 4000 AND (p_size % 3 = 0 OR p_size * 400 / 2.0 * 0.95 <= 3500) THEN 'nyquist' WHEN p_size % 3 > 0 THEN 'microphone' END AS bound FROM part"
)
def band_limits(spark, sf_dir):
    e, p = F.expr, table(spark, sf_dir, "part")
    band = A.clamped_band(F.lit(100.0), F.col("p_size") * 20.0, F.col("p_size") / 20.0, 343.0)
    return p.select("p_partkey", F.round(band["high"], 6).alias("high"), A.band_reach(F.lit(4000.0), F.col("p_size") * 400, e("if(p_size % 3 = 0, NULL, 3500D)")).alias("bound"))


@query(
    "WITH p AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, abs(a.n_nationkey * 1.7 % 5 - b.n_nationkey * 1.7 % 5) AS dt, sqrt(pow(a.n_nationkey - b.n_nationkey, 2) + pow(a.n_regionkey - b.n_regionkey, 2)) * 50 / 343.0 AS bound FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey), "
    "c AS (SELECT i, count(*) FILTER (dt > bound + 0.5) AS n_bad FROM p GROUP BY 1) SELECT i AS node, n_bad, n_bad = (SELECT max(n_bad) FROM c) AND n_bad > 0 AS suspect FROM c"
)
def rogue_arrivals(spark, sf_dir):
    """How many pairs of a node break the speed of sound, and who breaks it most; a survey of receivers is joined with itself."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS node", "n_nationkey * 1.7D % 5 AS t", "n_nationkey * 1.0D AS x", "n_regionkey * 1.0D AS y")
    a, b = n.alias("a"), n.alias("b")
    bound = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2)) * 50 / 343.0
    c = a.join(b, F.col("a.node") != F.col("b.node")).groupBy(F.col("a.node").alias("node")).agg(F.count_if(F.abs(F.col("a.t") - F.col("b.t")) > bound + 0.5).alias("n_bad"))
    worst = c.agg(F.max("n_bad").alias("worst"))
    return c.join(worst).select("node", "n_bad", ((F.col("n_bad") == F.col("worst")) & (F.col("n_bad") > 0)).alias("suspect"))


@query(
    "SELECT event_id, list_filter([CASE WHEN user_id % 11 = 0 THEN 'no_device' END, CASE WHEN value < 0.5 THEN 'counters.rows: not an integer' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'error') THEN 'event_type: unknown' END, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 95 THEN 'rssi: out of range' END], lambda x: x IS NOT NULL) AS faults FROM events"
)
def heartbeat_faults(spark, sf_dir):
    """All faults of a report by field, none decided by an exception."""
    rules = [
        (F.col("user_id") % 11 == 0, "no_device"),
        (F.col("value") < 0.5, "counters.rows: not an integer"),
        (~F.col("event_type").isin("click", "view", "purchase", "error"), "event_type: unknown"),
        (F.get_json_object("props", "$.k").cast("long") > 95, "rssi: out of range"),
    ]
    return table(spark, sf_dir, "events").select("event_id", C.all_reasons(rules).alias("faults"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 3")
def tenant_view(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("tenant_id", F.col("o_custkey") % 7)
    return A.of_tenant(rows, 3).select("o_orderkey", "o_custkey")


@query(
    "WITH k AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'app:devices' WHEN page_id % 5 = 1 THEN 'app:event:' || page_id WHEN page_id % 5 = 2 THEN 'app:' || page_id WHEN page_id % 5 = 3 THEN 'app:a:b:c' ELSE 'app:event:' END AS key FROM pages) "
    "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'registry' WHEN page_id % 5 = 1 THEN 'last_event' WHEN page_id % 5 = 2 THEN 'signal' END AS rule FROM k"
)
def key_classes(spark, sf_dir):
    key = F.expr("CASE WHEN page_id % 5 = 0 THEN 'app:devices' WHEN page_id % 5 = 1 THEN concat('app:event:', page_id) WHEN page_id % 5 = 2 THEN concat('app:', page_id) WHEN page_id % 5 = 3 THEN 'app:a:b:c' ELSE 'app:event:' END")
    rules = [("app:event:{device_id}", "last_event"), ("app:devices", "registry"), ("app:{device_id}", "signal")]
    return table(spark, sf_dir, "pages").select("page_id", A.key_rule(key, rules).alias("rule"))


_RECORD = """CASE WHEN event_id % 7 = 0 THEN '{"arrivals": [{"node_id": 1, "pcm_b64": "x"}], "id": ' || event_id || '}' WHEN event_id % 7 = 1 THEN '{"Waveform": [1, 2], "transcript": "' || event_type || '"}' WHEN event_id % 7 = 2 THEN '{"sample_rate_hz": 16000, "zero_audio_retained": true}' ELSE '{"type": "' || event_type || '", "note": "audio"}' END"""


@query(
    f"WITH r AS (SELECT event_id, user_id, {_RECORD} AS record FROM events), k AS (SELECT event_id, user_id, list_distinct(list_transform(regexp_extract_all(record, '\"([^\"\\\\]+)\"\\s*:', 1), lambda x: lower(x))) AS names FROM r), "
    "f AS (SELECT user_id, list_sort(list_filter(names, lambda x: x NOT IN ('sample_rate_hz', 'zero_audio_retained') AND regexp_matches(x, 'audio|sample|waveform|pcm|spectrum|spectrogram|embedding|voiceprint|transcript|words|content'))) AS found FROM k) "
    "SELECT user_id, count(*) AS n, count(*) FILTER (len(found) = 0) AS n_kept, CAST(coalesce(sum(len(found)), 0) AS BIGINT) AS n_forbidden, max(array_to_string(found, ',')) AS last_found FROM f GROUP BY 1"
)
def sound_carriers(spark, sf_dir):
    """Derived records that name something from which sound or speech could be made again, at any depth, are refused before they are purged or sent."""
    from echofold.operators.clips import forbidden_keys

    records = table(spark, sf_dir, "events").select("user_id", F.expr(_RECORD).alias("record")).select("user_id", forbidden_keys(F.col("record")).alias("found"))
    n = F.size("found")
    return records.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(n == 0).alias("n_kept"), F.sum(n).cast("long").alias("n_forbidden"), F.max(F.array_join("found", ",")).alias("last_found"))
