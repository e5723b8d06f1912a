"""Queries on admission, reconciliation, digests, aggregates and fusion, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.functions import acoustics as A
from echofold.operators import classify as C
from echofold.operators import fusion
from echofold.operators import relational as R
from echofold.plans.tables import DAY, DETS, HOUR, detections, micros, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


UNIT = "chr(31)"


@query(
    f"WITH {DETS}, c AS (SELECT CASE WHEN t <= 0 THEN 'unanchored' WHEN t >= 1706000000000000 THEN 'pending_settle' WHEN t < 1704412800000000 THEN 'outside_window' "
    "WHEN source = 'error' THEN 'not_arrival_class' WHEN node % 10 = 0 THEN 'not_surveyed' WHEN value > 150 THEN 'sigma_over_budget' ELSE 'admitted' END AS reason FROM d) SELECT reason, count(*) AS n FROM c GROUP BY 1"
)
def admission_reasons(spark, sf_dir):
    d = detections(spark, sf_dir)
    rules = [
        (F.col("t") <= 0, "unanchored"),
        (F.col("t") >= 1706000000000000, "pending_settle"),
        (F.col("t") < 1704412800000000, "outside_window"),
        (F.col("source") == "error", "not_arrival_class"),
        (F.col("node") % 10 == 0, "not_surveyed"),
        (F.col("value") > 150, "sigma_over_budget"),
    ]
    return C.tally(d.withColumn("reason", C.first_reason(rules)))


@query(
    "SELECT doc_id, list_filter([CASE WHEN n_chars > 4000 THEN 'too_long' END, CASE WHEN lang IS NULL THEN 'no_lang' END, CASE WHEN source NOT IN ('web', 'news', 'books') THEN 'unknown_source' END, CASE WHEN text IS NULL OR text = '' THEN 'no_body' END], lambda x: x IS NOT NULL) AS reasons FROM documents"
)
def field_validation(spark, sf_dir):
    rules = [
        (F.col("n_chars") > 4000, "too_long"),
        (F.col("lang").isNull(), "no_lang"),
        (~F.col("source").isin("web", "news", "books"), "unknown_source"),
        (F.col("text").isNull() | (F.col("text") == ""), "no_body"),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", C.all_reasons(rules).alias("reasons"))


@query("SELECT d.doc_id, NOT (l.quality IS NOT DISTINCT FROM 0) AS is_usable FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def arrival_usability(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") != 0).alias("flag"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", C.not_false(F.col("flag")).alias("is_usable"))


@query("SELECT event_id, sqrt(0.0001 + pow(CAST(json_extract(props, '$.k') AS DOUBLE) / 1000, 2)) <= 0.05 AS stamp_admissible FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 0 UNION ALL SELECT event_id, NULL FROM events WHERE NOT coalesce(CAST(json_extract(props, '$.k') AS BIGINT) > 0, false)")
def stamp_budget(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", (A.stamp_sigma(F.lit(0.01), k * 1000000) <= 0.05).alias("stamp_admissible"))


@query("SELECT event_id, CASE WHEN try_cast(props AS JSON) IS NULL THEN 'not_json' WHEN json_extract(props, '$.k') IS NULL THEN 'no_field' WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 90 THEN 'out_of_range' ELSE 'ok' END AS verdict FROM events")
def poison_classifier(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rules = [(F.try_parse_json("props").isNull(), "not_json"), (k.isNull(), "no_field"), (k.cast("long") > 90, "out_of_range")]
    return table(spark, sf_dir, "events").select("event_id", C.first_reason(rules, "ok").alias("verdict"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, 'page=|ref=') THEN sha256(url) ELSE url END AS shown FROM pages")
def redacted_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").rlike("page=|ref="), F.sha2("url", 256)).otherwise(F.col("url")).alias("shown"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*\\.example\\.net/en/') THEN 'en_net' WHEN regexp_matches(url, '\\.example\\.net') THEN 'net' WHEN regexp_matches(url, '^http') THEN 'web' ELSE 'other' END AS family FROM pages")
def line_families(spark, sf_dir):
    u = F.col("url")
    rules = [(u.rlike(r"^https?://[^/]*\.example\.net/en/"), "en_net"), (u.rlike(r"\.example\.net"), "net"), (u.rlike("^http"), "web")]
    return table(spark, sf_dir, "pages").select("page_id", C.first_reason(rules, "other").alias("family"))


@query("SELECT event_id, value BETWEEN 35 AND 65 AS needs_label FROM events")
def active_learning_band(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("value").between(35, 65).alias("needs_label"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def pending_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'purchase' AND n.event_id > e.event_id)")
def superseded_semi(spark, sf_dir):
    # The newest acknowledged row of each key decides; no pair of rows is formed.
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    newest = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("newest"))
    return e.join(newest, "user_id").where("event_id < newest").select("event_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') GROUP BY 1")
def orphan_identities(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(n_chars > 1000 AS INTEGER) AS priority FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY priority DESC, doc_id LIMIT 100")
def annotation_queue(spark, sf_dir):
    todo = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return todo.select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(100)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_wins(spark, sf_dir):
    return R.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(
    "WITH f AS (SELECT *, first_value(l_suppkey) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey) AS body FROM lineitem) "
    "SELECT l_orderkey, l_returnflag, any_value(body) AS body, count(*) AS arrivals, count(*) FILTER (l_suppkey = body) - 1 AS duplicates, count(*) FILTER (l_suppkey <> body) AS conflicts FROM f GROUP BY 1, 2"
)
def first_wins_persist(spark, sf_dir):
    return R.first_wins(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_suppkey"], "l_suppkey")


@query(
    "WITH s AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber < 6 GROUP BY 1), o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 3) "
    "SELECT coalesce(s.k, o.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'extra' WHEN o.st = 'F' AND s.n > 3 THEN 'state_differs' WHEN s.q * 5000 < o.p THEN 'value_differs' ELSE 'match' END AS verdict FROM o FULL JOIN s ON o.k = s.k"
)
def reconcile_full_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("p"))
    s = table(spark, sf_dir, "lineitem").where("l_linenumber < 6").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return R.reconcile(o, s, ["k"], lambda l, r: [((l("st") == "F") & (r("n") > 3), "state_differs"), (r("q") * 5000 < l("p"), "value_differs")])


@query(
    "WITH a AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 11 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END AS user_id, event_type FROM events WHERE event_id % 17 <> 0), "
    "c AS (SELECT CASE WHEN b.event_id IS NULL AND a.event_id % 2 = 0 THEN 'pending' WHEN b.event_id IS NULL THEN 'missing_canonical' WHEN a.event_id IS NULL THEN 'missing_legacy' WHEN a.user_id <> b.user_id THEN 'identity_mismatch' WHEN a.event_type = 'error' THEN 'error_legacy' ELSE 'match' END AS class FROM a FULL JOIN b USING (event_id)) SELECT class, count(*) AS n FROM c GROUP BY 1"
)
def dual_write_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    a = e.where("event_id % 11 <> 0").alias("a")
    b = e.where("event_id % 17 <> 0").withColumn("user_id", F.expr("if(event_id % 13 = 0, user_id + 1, user_id)")).alias("b")
    no_a, no_b = F.col("a.event_id").isNull(), F.col("b.event_id").isNull()
    rules = [
        (no_b & (F.col("a.event_id") % 2 == 0), "pending"),
        (no_b, "missing_canonical"),
        (no_a, "missing_legacy"),
        (F.col("a.user_id") != F.col("b.user_id"), "identity_mismatch"),
        (F.col("a.event_type") == "error", "error_legacy"),
    ]
    return C.tally(a.join(b, F.col("a.event_id") == F.col("b.event_id"), "full_outer").select(C.first_reason(rules, "match").alias("class")), "class")


@query(f"SELECT o_orderpriority, CAST(o_orderdate AS DATE)::VARCHAR AS day, sha256(string_agg(CAST(o_orderkey AS VARCHAR), {UNIT} ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY 1, 2")
def bucket_digests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return o.groupBy("o_orderpriority", day).agg(R.sequence_digest(F.col("o_orderkey"), F.col("o_orderkey").cast("string")).alias("digest"), F.count("*").alias("n"))


@query(
    f"SELECT user_id, sha256(string_agg(DISTINCT event_type, {UNIT} ORDER BY event_type)) AS membership, sha256(string_agg(event_type, {UNIT} ORDER BY event_id)) AS sequence FROM events GROUP BY 1"
)
def membership_vs_order_digest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(R.set_digest(F.col("event_type")).alias("membership"), R.sequence_digest(F.col("event_id"), F.col("event_type")).alias("sequence"))


@query("SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS members, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1 HAVING count(*) > 1")
def uid_collisions(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return g.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("members"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id")).where("n > 1")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_bodies FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def identity_conflicts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_bodies")).where("n_bodies > 1")


@query(
    "WITH a AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN l_suppkey % 4 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS v FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY 1) "
    "SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n < 5 OR b.n < 5 THEN 'suppressed' WHEN a.n <> b.n THEN 'count_differs' WHEN abs(a.v - b.v) > 0.5 THEN 'value_differs' ELSE 'match' END AS verdict FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey"
)
def aggregate_compare_k_anon(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    a = l.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("v"))
    b = l.where("l_suppkey % 9 <> 0").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(F.expr("if(l_suppkey % 4 = 0, l_quantity + 1, l_quantity)")).alias("v"))
    return R.compare_cells(a, b, ["l_suppkey"], "v", 0.5, 5)


@query("SELECT user_id, event_type, CASE WHEN count(*) >= 5 THEN count(*) END AS n, CASE WHEN count(*) >= 5 THEN round(sum(value), 2) END AS total, count(*) < 5 AS is_suppressed FROM events GROUP BY 1, 2")
def suppressed_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return R.suppressed(cells, "n", 5, "total")


@query("SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (l_linestatus = 'O') - 1, max(l_linenumber)) AS ack_through, count(*) AS submitted FROM lineitem GROUP BY 1")
def contiguous_ack(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "O", "deferred").otherwise("accepted"))
    return R.ack_through(l, ["l_orderkey"], "l_linenumber", "status")


@query(
    "WITH e AS (SELECT unnest([5.0, 20.0, 80.0, 320.0, NULL]::DOUBLE[]) AS le) SELECT event_type, e.le, count(*) FILTER (e.le IS NULL OR value <= e.le) AS n FROM events, e GROUP BY 1, 2"
)
def histogram_buckets(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [5.0, 20.0, 80.0, 320.0])


@query(
    "WITH s AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, n, v[least(n, CAST(floor(n * 0.1) AS BIGINT) + 1)] AS p10, v[least(n, CAST(floor(n * 0.5) AS BIGINT) + 1)] AS p50, v[least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)] AS p95 FROM s"
)
def nearest_index_percentiles(spark, sf_dir):
    return R.nearest_index_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p95": 0.95})


@query("SELECT event_id FROM events WHERE CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 16 = 0")
def audit_sample(spark, sf_dir):
    return R.sampled(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), 16)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 OR (o_totalprice = 100000 AND o_orderkey > 10) ORDER BY o_totalprice, o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return R.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (100000.0, 10), 50)


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS due FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 64")
def claim_due(spark, sf_dir):
    due = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(64)
    return due.select("o_orderkey", F.col("o_orderdate").cast("string").alias("due"))


@query(
    f"WITH r AS (SELECT user_id, event_id, CAST(value AS VARCHAR) AS body, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS slice FROM events) SELECT user_id, slice, count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), {UNIT} ORDER BY event_id)) AS digest FROM r GROUP BY 1, 2"
)
def export_slices(spark, sf_dir):
    s = R.rank_slices(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 20)
    return s.groupBy("user_id", "slice").agg(F.count("*").alias("n"), R.sequence_digest(F.col("event_id"), F.col("event_id").cast("string")).alias("digest"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'O') AS n_open, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'refuse' ELSE 'drop' END AS action FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def daily_retention_plan(spark, sf_dir):
    old = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'1997-01-01'")
    g = old.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    return g.withColumn("action", F.when(F.col("n_open") > 0, "refuse").otherwise("drop"))


@query("SELECT count(*) AS n_records, count(*) FILTER (o_orderstatus = 'O') AS n_pending, min(epoch_us(o_orderdate)) FILTER (o_orderstatus = 'O') AS oldest_pending, max(epoch_us(o_orderdate)) AS newest FROM orders")
def health_snapshot(spark, sf_dir):
    o, t, pending = table(spark, sf_dir, "orders"), micros("o_orderdate"), F.col("o_orderstatus") == "O"
    return o.agg(F.count("*").alias("n_records"), F.count_if(pending).alias("n_pending"), F.min(F.when(pending, t)).alias("oldest_pending"), F.max(t).alias("newest"))


@query(
    "SELECT event_type, user_id % 5 AS grp, count(*) AS n, count(DISTINCT user_id) AS n_nodes FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), (event_type, user_id % 5), ())"
)
def pool_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 5)
    return e.groupingSets([["event_type"], ["grp"], ["event_type", "grp"], []], "event_type", "grp").agg(F.col("event_type"), F.col("grp"), F.count("*").alias("n"), F.count_distinct("user_id").alias("n_nodes")).select("event_type", "grp", "n", "n_nodes")


@query("WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_type, any_value(med) AS median, median(abs(value - med)) AS mad, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY 1")
def latency_fit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.groupBy("event_type").agg(F.median("value").alias("med"))
    return e.join(m, "event_type").groupBy("event_type").agg(F.any_value("med").alias("median"), F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.count("*").alias("n"))


@query(f"WITH {DETS}, b AS (SELECT node, t // {DAY} AS day, median(value) AS m FROM d GROUP BY 1, 2) SELECT node, count(*) AS n_blocks, round(median(m), 6) AS centre, CASE WHEN count(*) >= 3 THEN round(stddev_pop(m), 6) END AS sigma FROM b GROUP BY 1")
def survey_medians(spark, sf_dir):
    b = detections(spark, sf_dir).groupBy("node", F.floor(F.col("t") / DAY).alias("day")).agg(F.median("value").alias("m"))
    return b.groupBy("node").agg(F.count("*").alias("n_blocks"), F.round(F.median("m"), 6).alias("centre"), F.when(F.count("*") >= 3, F.round(F.stddev_pop("m"), 6)).alias("sigma"))


@query(f"WITH {DETS}, l AS (SELECT node, max(t) AS t, arg_max(value, t) AS v FROM d GROUP BY 1) SELECT count(*) AS n_fresh, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance FROM l WHERE t >= (SELECT max(t) FROM d) - {24 * HOUR}")
def fleet_temperature(spark, sf_dir):
    d = detections(spark, sf_dir)
    last = d.groupBy("node").agg(F.max(F.struct("t", "value")).alias("b")).select("b.t", "b.value")
    newest = F.broadcast(d.agg(F.max("t").alias("newest")))
    fresh = last.join(newest, F.col("t") >= F.col("newest") - 24 * HOUR)
    return fresh.agg(F.count("*").alias("n_fresh"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 6).alias("variance"))


@query(
    f"WITH {DETS}, w AS (SELECT t // {HOUR} AS g, node, least(value, 99) / 100 AS p, pow(10, greatest(-20.0, (value - 40) / 4) / 10) AS w FROM d), z AS (SELECT *, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z FROM w) "
    "SELECT g, count(*) AS n_obs, count(DISTINCT node) AS n_nodes, round(1 / (1 + exp(-count(*) * sum(w * z) / sum(w))), 6) AS p_logodds, round(sum(w * p) / sum(w), 6) AS p_linear, least(12.0, 3.0 * (count(DISTINCT node) - 1))::DOUBLE AS bonus_db FROM z GROUP BY 1"
)
def logodds_fusion(spark, sf_dir):
    d = detections(spark, sf_dir).select(F.floor(F.col("t") / HOUR).alias("g"), "node", (F.least(F.col("value"), F.lit(99.0)) / 100).alias("p"), ((F.col("value") - 40) / 4).alias("snr"))
    f = fusion.fuse(d, ["g"], "node", "p", "snr")
    return f.withColumns({"p_logodds": F.round("p_logodds", 6), "p_linear": F.round("p_linear", 6)})


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_type, round(avg(value), 6) AS confidence, count(*) AS n_used FROM r WHERE k <= 3 GROUP BY 1, 2")
def topk_window_scores(spark, sf_dir):
    t = fusion.top_k_mean(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id", 3)
    return t.withColumn("confidence", F.round("confidence", 6))


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) <= 1000 AS is_kept FROM events")
def prune_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("newest", -F.col("event_id"))
    return R.running_cap(e, ["user_id"], ["newest"], "value", 1000.0).select("user_id", "event_id", "is_kept")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sha256(CAST(event_id AS VARCHAR))) AS turn FROM events")
def stratified_rounds(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.sha2(F.col("event_id").cast("string"), 256))
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("turn"))


@query(f"WITH b AS (SELECT sha256(html) AS body, page_id FROM pages UNION ALL SELECT sha256(html), page_id + 100000 FROM pages WHERE page_id % 3 = 0) SELECT body, min(page_id) AS first_id, count(*) AS arrivals FROM b GROUP BY 1")
def merged_sources(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.sha2("html", 256).alias("body"), "page_id")
    both = p.unionByName(p.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100000))
    return both.groupBy("body").agg(F.min("page_id").alias("first_id"), F.count("*").alias("arrivals"))


@query(f"SELECT event_id, left(sha256(concat(event_type, {UNIT}, CAST(user_id AS VARCHAR), {UNIT}, CAST(event_id AS VARCHAR), {UNIT}, coalesce(props, ''))), 32) AS key FROM events")
def content_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", A.content_key(F.col("event_type"), F.col("user_id"), F.col("event_id"), body=F.encode(F.coalesce("props", F.lit("")), "UTF-8")).alias("key"))


@query(
    "WITH s AS (SELECT doc_id, min(sha256(CASE WHEN doc_id % 50 = 0 THEN text || ' ' ELSE text END)) AS digest FROM documents WHERE doc_id % 77 <> 5 GROUP BY 1) SELECT d.doc_id, CASE WHEN s.digest IS NULL THEN 'no_digest' WHEN s.digest <> sha256(d.text) THEN 'bad' ELSE 'ok' END AS verdict FROM documents d LEFT JOIN s USING (doc_id)"
)
def payload_integrity(spark, sf_dir):
    """Texts against digests stored beforehand, some of them of other texts, some missing."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    stored = d.where("doc_id % 77 <> 5").groupBy("doc_id").agg(F.min(F.sha2(text, 256)).alias("digest"))
    verdict = F.when(F.col("digest").isNull(), "no_digest").when(F.col("digest") != F.sha2("text", 256), "bad").otherwise("ok")
    return d.join(stored, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query("(SELECT c_nationkey AS k, 'missing' AS side FROM customer EXCEPT SELECT s_nationkey, 'missing' FROM supplier) UNION ALL (SELECT s_nationkey, 'extra' FROM supplier EXCEPT SELECT c_nationkey, 'extra' FROM customer) UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)")
def set_differences(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    sides = (c.subtract(s), "missing"), (s.subtract(c), "extra"), (c.intersect(s), "both")
    first, *rest = [x.withColumn("side", F.lit(name)) for x, name in sides]
    for x in rest:
        first = first.unionByName(x)
    return first


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm, label FROM embeddings")
def embedding_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(A.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), "label")


@query(
    "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, dim, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS deviation FROM u GROUP BY 1, 2"
)
def class_profiles(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return u.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 5).alias("deviation"))


@query("SELECT p_partkey, round(331.3 + 0.606 * p_size, 6) AS c, round(degrees(asin((331.3 + 0.606 * p_size) / 600.0)), 6) AS mach_deg, least(pow(2, least(p_size, 20)), 3600.0) AS backoff FROM part")
def acoustic_scalars(spark, sf_dir):
    c = A.sound_speed(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("c"), F.round(A.mach_angle_deg(F.lit(600.0), c), 6).alias("mach_deg"), A.backoff_seconds(F.col("p_size"), 3600.0).alias("backoff"))


@query(
    "WITH g AS (SELECT n_nationkey AS k, radians(n_nationkey * 3.0 - 40) AS la, radians(n_regionkey * 20.0 - 50) AS lo FROM nation), e AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(la) * sin(la)) AS n FROM g) "
    "SELECT k, round((n + 100) * cos(la) * cos(lo), 3) AS x, round((n + 100) * cos(la) * sin(lo), 3) AS y, round((n * (1 - 0.0066943799901413165) + 100) * sin(la), 3) AS z FROM e"
)
def geodetic_to_ecef(spark, sf_dir):
    x, y, z = A.ecef(F.col("n_nationkey") * 3.0 - 40, F.col("n_regionkey") * 20.0 - 50, F.lit(100.0))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query(
    "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS attempt, CASE WHEN l_returnflag = 'R' THEN 'published' WHEN l_linenumber >= 5 THEN 'dead_letter' ELSE 'pending' END AS state FROM lineitem) SELECT k, max(attempt) AS attempts, CASE WHEN bool_or(state = 'published') THEN 'published' ELSE arg_max(state, attempt) END AS state FROM a GROUP BY 1"
)
def outbox_states(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "R", "published").when(F.col("l_linenumber") >= 5, "dead_letter").otherwise("pending")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("attempt"), state.alias("state"))
    done = F.bool_or(F.col("state") == "published")
    return a.groupBy("k").agg(F.max("attempt").alias("attempts"), F.when(done, "published").otherwise(F.max_by("state", "attempt")).alias("state"))
