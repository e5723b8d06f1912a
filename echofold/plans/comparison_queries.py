"""Queries on compared surfaces, each with the SQL that it must agree with. Attributes of pairs are arithmetic on keys, the same text in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.operators import comparators as V
from echofold.operators import relational as R
from echofold.operators.classify import tally
from echofold.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _one(name: str, value: str, prime: int, rest: int, other: str) -> tuple[str, str]:
    return name, f"CASE WHEN k * 31 % {prime} = {rest} THEN {value} ELSE {other} END"


#: Most pairs agree in most things, and every rule holds for some.
WRITES = dict([
    ("k", "k"),
    ("l_outcome", "CASE WHEN k % 23 = 5 THEN 'absent' WHEN k * 7 % 41 = 3 THEN 'errored' WHEN k % 29 = 1 THEN 'duplicate' ELSE 'accepted' END"),
    ("r_outcome", "CASE WHEN k % 19 IN (5, 11) OR k % 437 = 5 THEN 'absent' WHEN k * 3 % 43 = 3 THEN 'errored' ELSE 'accepted' END"),
    _one("l_row_count", "2", 47, 9, "1"),
    _one("r_row_count", "2", 53, 9, "1"),
    _one("l_device_id", "'b'", 59, 4, "'a'"),
    ("r_device_id", "CASE WHEN k % 5 = 0 THEN NULL ELSE 'a' END"),
    ("age_s", "k % 700 * 1.0"),
    _one("sequence_gap", "1", 31, 6, "0"),
    _one("n_differences", "3", 37, 8, "0"),
    ("stale_side", "CASE WHEN k % 61 = 0 THEN 'canonical' WHEN k % 61 = 1 THEN 'legacy' END"),
    ("l_state_hash", "CASE WHEN k % 67 = 0 THEN NULL ELSE 'h' END"),
    _one("r_state_hash", "'g'", 71, 2, "'h'"),
])
WRITE_CASE = """CASE WHEN l_outcome = 'absent' AND r_outcome = 'absent' THEN 'unclassified'
 WHEN l_outcome <> 'absent' AND r_outcome <> 'absent' AND coalesce(l_device_id <> r_device_id, false) THEN 'identity_divergence'
 WHEN l_outcome = 'errored' THEN 'error_legacy' WHEN r_outcome = 'errored' THEN 'error_canonical' WHEN r_row_count > 1 THEN 'duplicate_canonical' WHEN l_row_count > 1 THEN 'duplicate_legacy'
 WHEN r_outcome = 'absent' AND age_s < 300 THEN 'pending' WHEN r_outcome = 'absent' THEN 'missing_canonical' WHEN l_outcome = 'absent' THEN 'missing_legacy'
 WHEN l_outcome <> r_outcome THEN 'outcome_divergence' WHEN sequence_gap = 1 AND age_s >= 300 THEN 'order_divergence' WHEN n_differences > 0 THEN 'value_divergence'
 WHEN stale_side = 'canonical' THEN 'stale_canonical' WHEN stale_side = 'legacy' THEN 'stale_legacy' WHEN l_state_hash IS NULL OR r_state_hash IS NULL THEN 'unclassified'
 WHEN l_state_hash <> r_state_hash THEN 'value_divergence' ELSE 'match' END"""


def _columns(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in fields.items())


def _pairs(spark, sf_dir, fields):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).selectExpr(*[f"{e} AS {n}" for n, e in fields.items()])


def _sql(fields: dict[str, str], case: str, rest: str) -> str:
    return f"WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT {_columns(fields)} FROM o), c AS (SELECT *, {case} AS class FROM p) {rest}"


@query(_sql(WRITES, WRITE_CASE, "SELECT k, class FROM c"))
def dual_write_all_classes(spark, sf_dir):
    p = _pairs(spark, sf_dir, WRITES)
    return p.select("k", V.write_class(p).alias("class"))


@query(
    _sql(
        WRITES,
        WRITE_CASE,
        "SELECT class, CASE WHEN class IN ('match', 'pending') THEN 'info' WHEN class IN ('missing_legacy', 'duplicate_legacy', 'stale_canonical', 'stale_legacy', 'order_divergence', 'error_canonical') THEN 'warn' ELSE 'critical' END AS severity, "
        "CASE WHEN class IN ('match', 'pending', 'order_divergence') THEN 'none' WHEN class IN ('missing_canonical', 'error_canonical') THEN 'replay_inbox' WHEN class = 'stale_canonical' THEN 'replay_outbox' ELSE 'manual_review' END AS repair, "
        "count(*) AS n, (SELECT count(*) FROM orders) AS n_compared FROM c GROUP BY 1",
    )
)
def dual_write_severity(spark, sf_dir):
    """Tallies by class with severity and repair, beside a count of the pairs that doesn't pass through the classes."""
    p = _pairs(spark, sf_dir, WRITES)
    counts = tally(p.select(V.write_class(p).alias("class")), "class")
    every = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_compared"))
    return counts.select("class", V.mapped(F.col("class"), 0).alias("severity"), V.mapped(F.col("class"), 1).alias("repair"), "n").join(every)


READS = dict([
    ("k", "k"),
    ("grain", "CASE WHEN k % 97 = 0 THEN 'page' WHEN k % 2 = 0 THEN 'row' ELSE 'result_set' END"),
    ("snapshot_skew_s", "CASE WHEN k % 89 = 0 THEN NULL WHEN k % 83 = 0 THEN -6.0 ELSE k % 6 * 1.0 END"),
    ("cursor_age_s", "CASE WHEN k % 79 = 0 THEN 90000.0 WHEN k % 3 = 0 THEN 100.0 END"),
    _one("l_outcome", "'unavailable'", 101, 7, "'ok'"),
    ("r_outcome", "CASE WHEN k % 73 = 0 THEN 'partial' ELSE 'ok' END"),
    _one("l_site_id", "'y'", 59, 4, "'x'"),
    ("r_site_id", "'x'"),
    _one("l_projection_version", "2", 103, 1, "1"),
    ("r_projection_version", "1"),
    _one("r_read_contract_major", "4", 61, 1, "3"),
    ("l_read_contract_major", "CASE WHEN k % 7 = 0 THEN NULL ELSE 3 END"),
    _one("l_fingerprint", "'p'", 67, 1, "'q'"),
    ("r_fingerprint", "'q'"),
    ("l_cursor_stable", "CASE WHEN k % 107 = 0 THEN false WHEN k % 2 = 0 THEN true END"),
    _one("cursor_gaps", "1", 109, 3, "0"),
    _one("l_row_count", "2", 47, 9, "1"),
    _one("r_row_count", "2", 53, 9, "1"),
    ("l_row_state", "CASE WHEN k % 29 = 2 THEN 'absent' WHEN k % 43 = 1 THEN 'tombstoned' WHEN k % 41 = 3 THEN 'retention_expired' ELSE 'present' END"),
    ("r_row_state", "CASE WHEN k % 23 IN (2, 9, 13) THEN 'absent' ELSE 'present' END"),
    ("age_s", "k % 9000 * 1.0"),
    ("late_s", "CASE WHEN k % 5 = 0 THEN 1800.0 WHEN k % 5 = 1 THEN 7200.0 END"),
    ("l_retention_horizon_s", "CASE WHEN k % 4 = 0 THEN 10000.0 END"),
    _one("truncated_side_only", "1", 37, 5, "0"),
    ("inversions", "CASE WHEN k % 19 = 4 THEN 2 ELSE 0 END"),
    _one("n_differences", "3", 31, 8, "0"),
    ("l_state_hash", "CASE WHEN k % 17 = 0 THEN NULL ELSE 'h' END"),
    _one("r_state_hash", "'g'", 13, 2, "'h'"),
    ("l_result_hash", "'h'"),
    _one("r_result_hash", "'g'", 11, 2, "'h'"),
])
NEAR = "coalesce(age_s >= l_retention_horizon_s - 3600, false)"
READ_CASE = f"""CASE WHEN grain = 'page' THEN 'comparator_fault' WHEN NOT coalesce(abs(snapshot_skew_s) <= 5, false) THEN 'comparator_fault' WHEN cursor_age_s > 86400 THEN 'comparator_fault'
 WHEN l_outcome = 'unavailable' THEN 'comparator_fault' WHEN l_site_id <> r_site_id THEN 'identity_divergence' WHEN l_projection_version <> r_projection_version THEN 'comparator_fault'
 WHEN l_read_contract_major <> r_read_contract_major THEN 'version_divergence' WHEN l_fingerprint <> r_fingerprint THEN 'filter_divergence'
 WHEN l_cursor_stable = false OR cursor_gaps > 0 THEN 'cursor_divergence' WHEN grain = 'row' AND r_row_count > 1 THEN 'duplicate_canonical_row' WHEN grain = 'row' AND l_row_count > 1 THEN 'duplicate_legacy_row'
 WHEN l_row_state = 'tombstoned' AND r_row_state = 'present' THEN 'tombstone_divergence' WHEN l_row_state = 'retention_expired' AND {NEAR} THEN 'match' WHEN l_row_state = 'retention_expired' THEN 'retention_divergence'
 WHEN l_row_state = 'present' AND r_row_state <> 'present' AND age_s < 900 THEN 'pending' WHEN l_row_state = 'present' AND r_row_state <> 'present' AND late_s > 0 AND late_s <= 3600 THEN 'late_arrival'
 WHEN l_row_state = 'present' AND r_row_state <> 'present' THEN 'missing_canonical_row' WHEN r_row_state = 'present' AND l_row_state <> 'present' THEN 'missing_legacy_row' WHEN r_row_state <> 'present' THEN 'match'
 WHEN grain = 'result_set' AND l_row_count <> r_row_count THEN 'count_divergence' WHEN truncated_side_only = 1 THEN 'pagination_divergence' WHEN inversions > 0 AND age_s >= 300 THEN 'order_divergence' WHEN inversions > 0 THEN 'match'
 WHEN n_differences > 0 THEN 'value_divergence' WHEN grain = 'row' AND (l_state_hash IS NULL OR r_state_hash IS NULL) THEN 'unclassified' WHEN grain = 'row' AND l_state_hash <> r_state_hash THEN 'value_divergence'
 WHEN grain = 'result_set' AND l_result_hash <> r_result_hash THEN 'value_divergence' WHEN l_outcome <> r_outcome THEN 'value_divergence' ELSE 'match' END"""


@query(_sql(READS, READ_CASE, "SELECT k, class FROM c"))
def shadow_read_classes(spark, sf_dir):
    p = _pairs(spark, sf_dir, READS)
    return p.select("k", V.read_class(p).alias("class"))


LISTS = READS | dict([
    ("grain", "CASE WHEN k % 97 = 0 THEN 'row' WHEN k % 4 = 0 THEN 'page' WHEN k % 4 = 1 THEN 'window' WHEN k % 4 = 2 THEN 'aggregate' ELSE 'export' END"),
    _one("l_surface_known", "false", 113, 2, "true"),
    _one("l_threshold_fingerprint", "'s'", 71, 1, "'t'"),
    ("r_threshold_fingerprint", "'t'"),
    _one("l_projection_fields_digest", "'d'", 83, 5, "'e'"),
    ("r_projection_fields_digest", "'e'"),
    ("l_pin_kind", "CASE WHEN k % 127 = 0 THEN NULL ELSE 'snapshot' END"),
    ("r_pin_kind", "'range_pin'"),
    _one("r_pin_fresh", "false", 131, 2, "true"),
    ("drift_kind", "CASE WHEN k % 37 = 1 THEN 'snapshot_drift' WHEN k % 37 = 2 THEN 'pin_absent' WHEN k % 37 IN (3, 4, 5) THEN 'insert_drift' WHEN k % 37 = 6 THEN 'else' ELSE 'none' END"),
    _one("tie_rows_reordered", "2", 61, 9, "0"),
    _one("r_membership_digest", "'m'", 43, 2, "'n'"),
    ("l_membership_digest", "'n'"),
    ("export_class", "CASE WHEN k % 31 = 3 THEN 'export_divergence' WHEN k % 31 = 7 THEN 'export_bound_exceeded' WHEN k % 31 = 11 THEN 'odd' END"),
])
LIST_CASE = f"""CASE WHEN grain = 'row' OR l_surface_known = false OR NOT coalesce(abs(snapshot_skew_s) <= 5, false) OR l_outcome = 'unavailable' THEN 'comparator_fault'
 WHEN l_threshold_fingerprint <> r_threshold_fingerprint THEN 'threshold_divergence' WHEN l_site_id <> r_site_id THEN 'scope_divergence' WHEN l_projection_version <> r_projection_version THEN 'comparator_fault'
 WHEN l_projection_fields_digest <> r_projection_fields_digest THEN 'projection_divergence' WHEN l_read_contract_major <> r_read_contract_major THEN 'version_divergence' WHEN l_fingerprint <> r_fingerprint THEN 'filter_divergence'
 WHEN l_pin_kind IS NULL OR r_pin_fresh = false OR drift_kind IN ('else', 'pin_absent') THEN 'comparator_fault' WHEN drift_kind = 'snapshot_drift' THEN 'snapshot_drift'
 WHEN l_cursor_stable = false OR cursor_gaps > 0 THEN 'cursor_divergence' WHEN tie_rows_reordered > 0 THEN 'tie_break_divergence'
 WHEN l_row_state = 'tombstoned' AND r_row_state = 'present' THEN 'tombstone_divergence' WHEN l_row_state = 'retention_expired' AND {NEAR} THEN 'match' WHEN l_row_state = 'retention_expired' THEN 'retention_divergence'
 WHEN l_row_state = 'present' AND r_row_state <> 'present' AND age_s < 900 THEN 'pending' WHEN l_row_state = 'present' AND r_row_state <> 'present' AND late_s > 0 AND late_s <= 3600 THEN 'late_arrival'
 WHEN (l_row_state = 'present') <> (r_row_state = 'present') THEN 'membership_divergence' WHEN r_row_state <> 'present' THEN 'match'
 WHEN l_row_count <> r_row_count AND age_s < 900 THEN 'pending' WHEN l_row_count <> r_row_count THEN 'count_divergence' WHEN l_membership_digest <> r_membership_digest THEN 'membership_divergence'
 WHEN grain = 'aggregate' AND n_differences > 0 THEN 'aggregate_divergence' WHEN grain = 'export' AND export_class IN ('export_divergence', 'export_bound_exceeded') THEN export_class WHEN grain = 'export' AND export_class = 'odd' THEN 'unclassified'
 WHEN truncated_side_only = 1 THEN 'pagination_divergence' WHEN inversions > 0 AND age_s >= 300 THEN 'order_divergence' WHEN inversions > 0 THEN 'match' WHEN drift_kind <> 'none' THEN 'boundary_drift'
 WHEN n_differences > 0 THEN 'count_divergence' WHEN l_result_hash <> r_result_hash THEN 'membership_divergence' WHEN l_outcome <> r_outcome THEN 'unclassified' ELSE 'match' END"""


@query(_sql(LISTS, LIST_CASE, "SELECT k, class FROM c"))
def list_read_classes(spark, sf_dir):
    p = _pairs(spark, sf_dir, LISTS)
    return p.select("k", V.list_class(p).alias("class"))


@query(
    _sql(
        LISTS,
        LIST_CASE,
        "SELECT grain, count(*) AS n, count(*) FILTER (class IN ('cursor_divergence', 'tie_break_divergence', 'count_divergence', 'membership_divergence', 'aggregate_divergence', 'export_divergence', 'filter_divergence', "
        "'projection_divergence', 'tombstone_divergence', 'threshold_divergence', 'scope_divergence', 'comparator_fault', 'unclassified')) AS n_critical, count(*) FILTER (class IN ('match', 'pending')) AS n_info FROM c GROUP BY 1",
    )
)
def list_read_gate(spark, sf_dir):
    """How many pairs of each grain would stop a release."""
    p = _pairs(spark, sf_dir, LISTS)
    s = V.severity(V.list_class(p))
    return p.select("grain", s.alias("s")).groupBy("grain").agg(F.count("*").alias("n"), F.count_if(F.col("s") == "critical").alias("n_critical"), F.count_if(F.col("s") == "info").alias("n_info"))


@query(
    "WITH r AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus AS body, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS slice FROM orders), "
    "x AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || ':' || CASE WHEN o_orderkey % 401 = 0 THEN '?' ELSE o_orderstatus END AS body, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS slice FROM orders WHERE o_orderkey % 307 <> 0), "
    "a AS (SELECT c, slice, count(*) AS n, sha256(string_agg(body, chr(31) ORDER BY k)) AS digest FROM r GROUP BY 1, 2), b AS (SELECT c, slice, count(*) AS n, sha256(string_agg(body, chr(31) ORDER BY k)) AS digest FROM x GROUP BY 1, 2), "
    "j AS (SELECT coalesce(a.c, b.c) AS c, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS e, coalesce(a.digest = b.digest AND a.n = b.n, false) AS same FROM a FULL JOIN b ON a.c = b.c AND a.slice = b.slice), "
    "g AS (SELECT c, CAST(sum(p) AS BIGINT) AS rows_paged, CAST(sum(e) AS BIGINT) AS rows_exported, count(*) FILTER (NOT same) AS slices_off FROM j GROUP BY 1) "
    "SELECT *, CASE WHEN c % 50 = 7 OR rows_exported > 20 THEN 'export_bound_exceeded' WHEN slices_off > 0 OR rows_paged <> rows_exported THEN 'export_divergence' ELSE 'match' END AS class FROM g"
)
def export_equivalence(spark, sf_dir):
    """Ordered slices of a paged read against those of an export with altered and missing rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), "o_orderstatus")

    def slices(rows):
        s = R.rank_slices(rows, ["c"], ["k"], 5)
        return s.groupBy("c", "slice").agg(F.count("*").alias("n"), R.sequence_digest(F.col("k"), F.concat(F.col("k").cast("string"), F.lit(":"), F.col("o_orderstatus"))).alias("digest"))

    exported = o.where("k % 307 <> 0").withColumn("o_orderstatus", F.expr("if(k % 401 = 0, '?', o_orderstatus)"))
    return V.export_class(slices(o), slices(exported), ["c"], F.col("c") % 50 != 7, most=20)


@query(
    "WITH q AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '^[a-z]+://[^?#]+') THEN lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) ELSE '' END AS base, "
    "list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '')) AS args FROM pages) "
    "SELECT page_id, left(sha256(base || '?' || array_to_string(args, '&')), 32) AS fingerprint, CAST(len(args) AS INTEGER) AS n_args FROM q"
)
def query_fingerprints(spark, sf_dir):
    """One fingerprint for requests that ask the same: scheme and host in lower case, arguments in order, fragment left out."""
    url = F.col("url")
    base = F.when(url.rlike("^[a-z]+://[^?#]+"), F.concat(F.lower(F.regexp_extract(url, "^([a-z]+://[^/?#]*)", 1)), F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1))).otherwise("")
    args = F.array_sort(F.filter(F.split(F.regexp_extract(url, "[?]([^#]*)", 1), "&"), lambda x: x != ""))
    q = table(spark, sf_dir, "pages").select("page_id", base.alias("base"), args.alias("args"))
    return q.select("page_id", F.left(F.sha2(F.concat("base", F.lit("?"), F.array_join("args", "&")), 256), F.lit(32)).alias("fingerprint"), F.size("args").alias("n_args"))


@query(
    _sql(
        WRITES,
        WRITE_CASE,
        ", d AS (SELECT k, class, list_filter([CASE WHEN l_outcome <> r_outcome THEN 'outcome' END, CASE WHEN l_row_count <> r_row_count THEN 'row_count' END, CASE WHEN coalesce(l_state_hash <> r_state_hash, false) THEN 'state_hash' END], lambda x: x IS NOT NULL) AS diffs FROM c) "
        "SELECT left(sha256('run-1' || chr(31) || CAST(k AS VARCHAR) || chr(31) || class || chr(31)), 32) AS receipt_id, k, class, list_slice(diffs, 1, 2) AS differences, CAST(greatest(len(diffs) - 2, 0) AS INTEGER) AS n_dropped FROM d WHERE class <> 'match'",
    )
)
def write_receipts(spark, sf_dir):
    """A receipt per pair that doesn't match: an id that reruns repeat, two differences at most and the number of the rest."""
    from echofold.functions.acoustics import content_key

    p = _pairs(spark, sf_dir, WRITES)
    names = ("outcome", "row_count", "state_hash")
    diffs = F.array_compact(F.array(*[F.when(F.col(f"l_{n}") != F.col(f"r_{n}"), F.lit(n)) for n in names]))
    d = p.select("k", V.write_class(p).alias("class"), diffs.alias("d")).where("class <> 'match'")
    return d.select(content_key(F.lit("run-1"), F.col("k"), F.col("class")).alias("receipt_id"), "k", "class", F.slice("d", 1, 2).alias("differences"), F.greatest(F.size("d") - 2, F.lit(0)).alias("n_dropped"))


@query(
    "WITH s AS (SELECT o_orderkey AS id, CAST(o_totalprice AS VARCHAR) AS body FROM orders WHERE o_orderkey > 100 AND o_orderkey <= (SELECT max(o_orderkey) FROM orders) - 50), "
    "d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0) SELECT CASE WHEN id IN (SELECT id FROM d) THEN 'skipped_present' WHEN id % 101 = 0 THEN 'refused' ELSE 'written' END AS outcome, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM s GROUP BY 1"
)
def backfill_batch(spark, sf_dir):
    """A resumed backfill: ids after a watermark up to a freeze, those present already skipped, refusals counted."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    freeze = o.agg((F.max("id") - 50).alias("freeze"))
    present = o.where("id % 3 = 0").withColumn("present", F.lit(True))
    rows = o.where("id > 100").join(freeze, F.col("id") <= F.col("freeze")).join(present, "id", "left")
    outcome = F.when(F.col("present"), "skipped_present").when(F.col("id") % 101 == 0, "refused").otherwise("written")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    "WITH d AS (SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT o_custkey) AS nodes FROM orders GROUP BY 1), g AS (SELECT *, lag(n) OVER (PARTITION BY left(day, 7) ORDER BY day) AS before FROM d) "
    "SELECT day, n, n - before AS delta, CASE WHEN before IS NULL THEN 'unknown' WHEN nodes < 3 THEN 'fail' WHEN n * 2 < before THEN 'fail' ELSE 'pass' END AS verdict FROM g"
)
def soak_grades(spark, sf_dir):
    """Consecutive samples of a soak, graded: unknown without an earlier one, fail where it fell by half or too few nodes reported."""
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("nodes"))
    before = F.lag("n").over(Window.partitionBy(F.left("day", F.lit(7))).orderBy("day"))
    g = d.withColumn("before", before)
    verdict = F.when(F.col("before").isNull(), "unknown").when(F.col("nodes") < 3, "fail").when(F.col("n") * 2 < F.col("before"), "fail").otherwise("pass")
    return g.select("day", "n", (F.col("n") - F.col("before")).alias("delta"), verdict.alias("verdict"))


@query(
    "WITH s AS (SELECT page_id % 7 AS shape, count(*) AS n, count(*) FILTER (page_id % 5 = 0) AS n_forever, max(page_id) AS longest FROM pages GROUP BY 1) "
    "SELECT shape, n, CASE WHEN n_forever * 4 > n THEN 'no_expiry' WHEN longest > 220 THEN 'too_long' ELSE 'ok' END AS grade FROM s"
)
def census_gate(spark, sf_dir):
    """Grades of key shapes by how many never expire and by the longest time to live."""
    s = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 7).alias("shape")).agg(F.count("*").alias("n"), F.count_if(F.col("page_id") % 5 == 0).alias("n_forever"), F.max("page_id").alias("longest"))
    return s.select("shape", "n", F.when(F.col("n_forever") * 4 > F.col("n"), "no_expiry").when(F.col("longest") > 220, "too_long").otherwise("ok").alias("grade"))
