"""Queries on censuses, samples, limits and further joins, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.operators import census as S
from echofold.operators import temporal as W
from echofold.plans.tables import DAY, DETS, HOUR, MINUTE, detections, micros, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(
    "SELECT l_linenumber || 'x' || CAST(l_quantity AS INTEGER) || '@' || CAST(l_discount AS VARCHAR) || '-' || CAST(l_tax AS VARCHAR) AS geometry, count(*) AS n, count(DISTINCT l_suppkey) AS n_nodes, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row FROM lineitem GROUP BY l_linenumber, l_quantity, l_discount, l_tax"
)
def scene_geometries(spark, sf_dir):
    """Rows by the whole geometry, edges unrounded."""
    l = table(spark, sf_dir, "lineitem")
    g = l.groupBy("l_linenumber", "l_quantity", "l_discount", "l_tax").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_nodes"), F.min("l_orderkey").alias("first_row"), F.max("l_orderkey").alias("last_row"))
    name = F.concat(F.col("l_linenumber").cast("string"), F.lit("x"), F.col("l_quantity").cast("int").cast("string"), F.lit("@"), F.col("l_discount").cast("string"), F.lit("-"), F.col("l_tax").cast("string"))
    return g.select(name.alias("geometry"), "n", "n_nodes", "first_row", "last_row")


@query(
    f"WITH {DETS}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) < {HOUR}, false) AS again FROM d) SELECT source, count(*) AS n, count(DISTINCT node) AS n_nodes, count(*) FILTER (again) AS n_retriggers, count(*) FILTER (value >= 150) AS n_clipped, min(t) AS t_from, max(t) AS t_to FROM g GROUP BY 1"
)
def corpus_summary(spark, sf_dir):
    g = W.gaps(detections(spark, sf_dir), ["node"], "t", "seq").withColumn("again", F.coalesce(F.col("gap") < HOUR, F.lit(False)))
    return g.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes"), F.count_if("again").alias("n_retriggers"), F.count_if(F.col("value") >= 150).alias("n_clipped"), F.min("t").alias("t_from"), F.max("t").alias("t_to"))


RECEIVER = {
    "n_rows": "true", "n_unanchored": "seq % 53 = 1", "n_untrusted": "seq % 27 = 9", "n_stamped": "seq % 4 <> 0", "n_over_budget": "seq % 4 <> 0 AND seq % 131 > 119", "n_onset_false": "seq % 37 = 2",
    "n_onset_unstated": "seq % 37 <> 2 AND seq % 2 = 1", "n_clipped": "value >= 150", "n_corrected": "seq % 9 = 0 AND seq % 2 = 0",
}


@query(f"WITH {DETS} SELECT node, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in RECEIVER.items())}, node % 5 AS class, CASE WHEN node % 3 > 0 THEN round(node % 7 * 0.1, 3) END AS bias_ms FROM d GROUP BY node")
def receiver_census(spark, sf_dir):
    """Nine conditional counts per receiver beside what its class and calibration say."""
    d = detections(spark, sf_dir)
    counts = d.groupBy("node").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in RECEIVER.items()])
    dims = d.select("node").distinct().select("node", (F.col("node") % 5).alias("class"), F.expr("CASE WHEN node % 3 > 0 THEN round(node % 7 * 0.1D, 3) END").alias("bias_ms"))
    return counts.join(dims, "node")


@query(
    "WITH l AS (SELECT CASE WHEN event_id % 41 = 3 THEN NULL ELSE user_id * 10 + event_id % 7 END AS key FROM events) SELECT count(*) AS n_lines, count(DISTINCT key) AS n_keys, count(key) - count(DISTINCT key) AS n_superseded, count(*) - count(key) AS n_unparseable FROM l"
)
def tag_index_census(spark, sf_dir):
    """Lines are keys, superseded lines and lines that can't be read."""
    l = table(spark, sf_dir, "events").select(F.expr("CASE WHEN event_id % 41 = 3 THEN NULL ELSE user_id * 10 + event_id % 7 END").alias("key"))
    n, keys, stated = F.count("*"), F.count_distinct("key"), F.count("key")
    return l.agg(n.alias("n_lines"), keys.alias("n_keys"), (stated - keys).alias("n_superseded"), (n - stated).alias("n_unparseable"))


@query("SELECT event_type, user_id % 10 AS grp, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def merged_counters(spark, sf_dir):
    """Counters kept up by increments: a stored state and a batch merge to what a full count gives."""
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 10)

    def counters(rows):
        return rows.groupBy("event_type", "grp").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last_id"))

    both = counters(e.where("event_id <= 5000")).unionByName(counters(e.where("event_id > 5000")))
    return both.groupBy("event_type", "grp").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.max("last_id").alias("last_id"))


@query(
    "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS k, max(event_id) OVER (PARTITION BY event_type, user_id) AS newest FROM events) SELECT event_id FROM r ORDER BY k, newest LIMIT 3000"
)
def largest_offender_cap(spark, sf_dir):
    return S.kept_under_cap(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"], "event_id", 3000).select("event_id")


@query(
    f"WITH {DETS}, n AS (SELECT node, max(t) AS last, count(DISTINCT t // {DAY}) AS days, count(DISTINCT source) AS n_sources FROM d GROUP BY 1), w AS (SELECT max(t) AS now, max(t) // {DAY} - min(t) // {DAY} + 1 AS all_days FROM d) "
    f"SELECT node, now - last AS age, all_days - days AS days_missing, CASE WHEN n_sources < 4 THEN 'unknown' WHEN now - last > {12 * HOUR} THEN 'degraded' ELSE 'healthy' END AS state FROM n, w"
)
def fleet_drift_report(spark, sf_dir):
    d = detections(spark, sf_dir)
    n = d.groupBy("node").agg(F.max("t").alias("last"), F.count_distinct(F.floor(F.col("t") / DAY)).alias("days"), F.count_distinct("source").alias("n_sources"))
    w = d.agg(F.max("t").alias("now"), (F.floor(F.max("t") / DAY) - F.floor(F.min("t") / DAY) + 1).alias("all_days"))
    age = F.col("now") - F.col("last")
    state = F.when(F.col("n_sources") < 4, "unknown").when(age > 12 * HOUR, "degraded").otherwise("healthy")
    return n.join(w).select("node", age.alias("age"), (F.col("all_days") - F.col("days")).alias("days_missing"), state.alias("state"))


@query(
    f"WITH {DETS}, u AS (SELECT node, source, CASE WHEN seq % 7 = 0 THEN NULL ELSE value END AS uptime FROM d WHERE seq % 3 = 0) SELECT node, count(*) AS n, count(*) FILTER (uptime <= 15) AS n_settling, count(*) FILTER (uptime > 15 OR uptime IS NULL) AS n_late, round(median(uptime), 6) AS median_uptime FROM u GROUP BY 1"
)
def unanchored_groups(spark, sf_dir):
    """Rows without an anchor, by whether the clock may still have been settling; an uptime that isn't stated counts as late."""
    u = detections(spark, sf_dir).where("seq % 3 = 0").withColumn("uptime", F.expr("if(seq % 7 = 0, NULL, value)"))
    late = F.coalesce(F.col("uptime") > 15, F.lit(True))
    return u.groupBy("node").agg(F.count("*").alias("n"), F.count_if(~late).alias("n_settling"), F.count_if(late).alias("n_late"), F.round(F.median("uptime"), 6).alias("median_uptime"))


LAGS = (1, 2, 4, 8, 16)


@query(
    f"WITH {DETS}, c AS (SELECT node, t, seq, value - avg(value) OVER (PARTITION BY node) AS c FROM d), l AS (SELECT node, c, {', '.join(f'lead(c, {k}) OVER w AS l{k}' for k in LAGS)} FROM c WINDOW w AS (PARTITION BY node ORDER BY t, seq)), "
    f"u AS ({' UNION ALL '.join(f'SELECT node, {k} AS lag, c, l{k} AS x FROM l' for k in LAGS)}), a AS (SELECT node, lag, count(x) AS n_pairs, round(sum(c * x) / sum(c * c), 6) AS acf FROM u GROUP BY 1, 2) "
    "SELECT node, max(lag) FILTER (acf >= 0.1) AS decorrelation_lag, coalesce(max(lag) FILTER (acf >= 0.1) = max(lag), false) AS is_censored FROM a WHERE n_pairs >= 8 GROUP BY 1"
)
def decorrelation_lag(spark, sf_dir):
    """The last of log-spaced lags whose level correlation is at least 0.1; censored where that is the longest one measured."""
    a = W.lag_products(detections(spark, sf_dir), ["node"], "t", "seq", "value", list(LAGS)).withColumn("acf", F.round("acf", 6))
    return S.last_above(a, ["node"], 0.1, 8)


@query(
    f"WITH {DETS}, b AS (SELECT node, t // {DAY} AS day, median(value) AS m FROM d WHERE node % 4 <> 1 OR t // {DAY} % 15 = 0 GROUP BY 1, 2), n AS (SELECT node, count(*) AS k, stddev_pop(m) / sqrt(count(*)) AS s FROM b GROUP BY 1), "
    f"x AS (SELECT node, value FROM d WHERE node % 4 <> 1 OR t // {DAY} % 15 = 0), c AS (SELECT node, median(value) AS mid FROM x GROUP BY 1), r AS (SELECT node, list_sort(list(abs(value - mid))) AS rad FROM x JOIN c USING (node) GROUP BY 1) "
    "SELECT node, k AS n_blocks, round(mid, 6) AS centre, round(CASE WHEN k >= 3 THEN s ELSE rad[CAST(floor(0.68 * (len(rad) - 1)) AS INTEGER) + 1] END, 6) AS sigma, k >= 3 AS from_blocks FROM n JOIN c USING (node) JOIN r USING (node)"
)
def survey_sigma(spark, sf_dir):
    """Error of a surveyed position: of the medians of blocks, or with fewer than three the radius that holds 68 percent."""
    x = detections(spark, sf_dir).where(f"node % 4 <> 1 or (t div {DAY}) % 15 = 0").select("node", "t", "value")
    b = x.groupBy("node", F.floor(F.col("t") / DAY).alias("day")).agg(F.median("value").alias("m"))
    n = b.groupBy("node").agg(F.count("*").alias("k"), (F.stddev_pop("m") / F.sqrt(F.count("*"))).alias("s"))
    c = x.groupBy("node").agg(F.median("value").alias("mid"))
    few = n.where("k < 3").select("node")
    # Only nodes with fewer than three blocks have their values gathered.
    r = x.join(few, "node").join(c, "node").groupBy("node").agg(F.array_sort(F.collect_list(F.abs(F.col("value") - F.col("mid")))).alias("rad"))
    out = n.join(c, "node").join(r, "node", "left")
    return out.select("node", F.col("k").alias("n_blocks"), F.round("mid", 6).alias("centre"), F.round(F.when(F.col("k") >= 3, F.col("s")).otherwise(S.nearest_index(F.col("rad"), F.size("rad"), 0.68, 1)), 6).alias("sigma"), (F.col("k") >= 3).alias("from_blocks"))


@query(
    "WITH m AS (SELECT user_id, median(value) AS med, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1), a AS (SELECT user_id, median(abs(value - med)) AS mad FROM events JOIN m USING (user_id) GROUP BY 1) "
    "SELECT user_id, n, round(med, 6) AS median, round(mad, 6) AS mad, v[CAST(floor(n * 0.1) AS INTEGER) + 1] AS p10, v[least(n, CAST(floor(n * 0.9) AS INTEGER) + 1)] AS p90 FROM m JOIN a USING (user_id)"
)
def latency_quantiles(spark, sf_dir):
    """Median, its absolute deviation, and the elements at a tenth and nine tenths, from counts per distinct value."""
    from echofold.operators.relational import nearest_index_percentiles

    e = table(spark, sf_dir, "events")
    m = e.groupBy("user_id").agg(F.median("value").alias("med"))
    a = e.join(m, "user_id").groupBy("user_id").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.any_value("med").alias("med"))
    p = nearest_index_percentiles(e, ["user_id"], "value", {"p10": 0.1, "p90": 0.9})
    return p.join(a, "user_id").select("user_id", "n", F.round("med", 6).alias("median"), F.round("mad", 6).alias("mad"), "p10", "p90")


FUNCTIONS = ("count", "distinct", "sum", "min", "max", "p50", "p95", "p99")


def _cells(value: str) -> str:
    return f"count(*) AS n, count(*) AS f_count, count(DISTINCT l_orderkey) AS f_distinct, sum({value}) AS f_sum, min({value}) AS f_min, max({value}) AS f_max, quantile_cont({value}, 0.5) AS f_p50, quantile_cont({value}, 0.95) AS f_p95, quantile_cont({value}, 0.99) AS f_p99"


_ALTERED = "CASE WHEN l_suppkey % 4 = 0 AND l_linenumber = 1 THEN l_quantity + 2 ELSE l_quantity END"


@query(
    f"WITH a AS (SELECT l_suppkey, {_cells('l_quantity')} FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, {_cells(_ALTERED)} FROM lineitem WHERE l_suppkey % 9 <> 0 AND l_orderkey % 211 <> 0 GROUP BY 1), "
    f"u AS ({' UNION ALL '.join(f'''SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, '{f}' AS function, a.n AS an, b.n AS bn, CAST(a.f_{f} AS DOUBLE) AS x, CAST(b.f_{f} AS DOUBLE) AS y FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey''' for f in FUNCTIONS)}) "
    "SELECT l_suppkey, function, CASE WHEN bn IS NULL THEN 'missing' WHEN an IS NULL THEN 'extra' WHEN an < 5 OR bn < 5 THEN 'suppressed' WHEN function IN ('count', 'distinct') AND x <> y THEN 'differs' WHEN function NOT IN ('count', 'distinct') AND abs(x - y) > 1.5 THEN 'differs' ELSE 'match' END AS verdict FROM u"
)
def aggregate_compare_functions(spark, sf_dir):
    """All eight functions of a cell on two surfaces: counts exact, the others within a tolerance, small cells held back."""
    l = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))

    def cells(rows, side):
        p = F.percentile("q", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
        g = rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("d"), F.sum("q").alias("s"), F.min("q").alias("lo"), F.max("q").alias("hi"), p.alias("p"))
        values = [F.col("n").cast("double"), F.col("d").cast("double"), F.col("s"), F.col("lo"), F.col("hi"), *[F.get("p", F.lit(k)) for k in range(3)]]
        return g.select("l_suppkey", F.col("n").alias(f"{side}_n"), F.posexplode(F.array(*values)).alias("at", side))

    b = l.where("l_suppkey % 9 <> 0 and l_orderkey % 211 <> 0").withColumn("q", F.expr("if(l_suppkey % 4 = 0 and l_linenumber = 1, q + 2, q)"))
    both = cells(l, "a").join(cells(b, "b"), ["l_suppkey", "at"], "full_outer")
    exact, off = F.col("at") < 2, F.abs(F.col("a") - F.col("b"))
    verdict = F.when(F.col("b_n").isNull(), "missing").when(F.col("a_n").isNull(), "extra").when((F.col("a_n") < 5) | (F.col("b_n") < 5), "suppressed").when(exact & (off > 0) | ~exact & (off > 1.5), "differs").otherwise("match")
    return both.select("l_suppkey", F.get(F.array(*[F.lit(f) for f in FUNCTIONS]), F.col("at")).alias("function"), verdict.alias("verdict"))


@query(
    f"WITH {DETS}, c AS (SELECT node, seq, t - {HOUR} AS l_from, t + {HOUR} AS l_to, t FROM d WHERE source = 'purchase'), s AS (SELECT node, seq, t - {HOUR // 4} AS r_from, t + {HOUR // 2} AS r_to, t FROM d WHERE source IN ('view', 'purchase')) "
    "SELECT c.node, c.seq AS l_id, s.seq AS r_id, s.t = c.t AS is_trigger FROM c JOIN s ON c.node = s.node AND s.r_from < c.l_to AND s.r_to > c.l_from"
)
def sketch_overlap(spark, sf_dir):
    """Clips and the sketches whose windows overlap them; the sketch that triggered the clip is marked by its own identity, here its time."""
    from echofold.operators import matching as M

    d = detections(spark, sf_dir)
    clips = d.where("source = 'purchase'").select("node", F.col("seq").alias("l_id"), (F.col("t") - HOUR).alias("l_from"), (F.col("t") + HOUR).alias("l_to"))
    sketches = d.where("source in ('view', 'purchase')").select("node", F.col("seq").alias("r_id"), (F.col("t") - HOUR // 4).alias("r_from"), (F.col("t") + HOUR // 2).alias("r_to"))
    found = M.overlapping(clips, sketches, "node", HOUR, most=1 << 30)
    return found.select("node", "l_id", "r_id", (F.col("r_from") + HOUR // 4 == F.col("l_from") + HOUR).alias("is_trigger"))


@query(
    f"WITH {DETS}, c AS (SELECT node, seq, t FROM d WHERE source = 'purchase'), s AS (SELECT node, seq, t FROM d WHERE source = 'view'), "
    f"r AS (SELECT c.node, c.seq AS l_id, s.seq AS r_id, row_number() OVER (PARTITION BY c.seq ORDER BY s.t, s.seq) AS k, count(*) OVER (PARTITION BY c.seq) AS n FROM c JOIN s ON c.node = s.node AND s.t < c.t + {12 * HOUR} AND s.t + {2 * HOUR} > c.t - {12 * HOUR}) SELECT node, l_id, r_id, n > 3 AS is_truncated FROM r WHERE k <= 3"
)
def capped_overlap(spark, sf_dir):
    """At most three partners a clip, the earliest, and whether there were more."""
    from echofold.operators import matching as M

    d = detections(spark, sf_dir)
    clips = d.where("source = 'purchase'").select("node", F.col("seq").alias("l_id"), (F.col("t") - 12 * HOUR).alias("l_from"), (F.col("t") + 12 * HOUR).alias("l_to"))
    scenes = d.where("source = 'view'").select("node", F.col("seq").alias("r_id"), F.col("t").alias("r_from"), (F.col("t") + 2 * HOUR).alias("r_to"))
    return M.overlapping(clips, scenes, "node", 24 * HOUR, most=3).select("node", "l_id", "r_id", F.col("truncated").alias("is_truncated"))


@query(
    "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'model' END AS provenance FROM documents), s AS (SELECT doc_id, list_sort(list(quality)) AS scenes FROM labels GROUP BY 1), k AS (SELECT doc_id, list_sort(list(lang)) AS sketches FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) "
    "SELECT doc_id, CASE WHEN provenance = 'model' THEN scenes END AS scenes, CASE WHEN provenance = 'model' THEN sketches END AS sketches, CASE WHEN provenance <> 'model' THEN 'not_a_model_tag' END AS refusal FROM t LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"
)
def tag_bundles(spark, sf_dir):
    """A tag with what its clip overlaps in two other tables, gathered; only a model's tags are explained this way."""
    d = table(spark, sf_dir, "documents")
    tags = d.select("doc_id", F.expr("if(doc_id % 5 = 0, 'manual', 'model')").alias("provenance"))
    scenes = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.array_sort(F.collect_list("quality")).alias("scenes"))
    sketches = d.where("doc_id % 2 = 0").groupBy("doc_id").agg(F.array_sort(F.collect_list("lang")).alias("sketches"))
    of_model = F.col("provenance") == "model"
    both = tags.join(scenes, "doc_id", "left").join(sketches, "doc_id", "left")
    return both.select("doc_id", F.when(of_model, F.col("scenes")).alias("scenes"), F.when(of_model, F.col("sketches")).alias("sketches"), F.when(~of_model, "not_a_model_tag").alias("refusal"))


@query(
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN 'dets' ELSE 'listing' END AS origin, coalesce(a.size, b.size) AS size FROM (SELECT o_orderkey AS k, o_custkey AS size FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_custkey + 1 AS size FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k"
)
def clip_candidates(spark, sf_dir):
    """Candidates of two origins by key; what the detections say wins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("size"))
    both = o.where("k % 3 <> 0").withColumn("origin", F.lit("dets")).unionByName(o.where("k % 5 <> 0").select("k", (F.col("size") + 1).alias("size"), F.lit("listing").alias("origin")))
    best = both.groupBy("k").agg(F.min(F.struct("origin", "size")).alias("best"))
    return best.select("k", "best.origin", "best.size")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) ORDER BY o_orderdate, o_orderkey LIMIT 200")
def unpromoted(spark, sf_dir):
    """What no promotion is recorded for, oldest first, with a unique column that breaks ties."""
    o = table(spark, sf_dir, "orders")
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    todo = o.join(done, "o_orderkey", "left_anti")
    return todo.orderBy(*S.total_order(todo, ["o_orderdate"], "o_orderkey")).limit(200).select("o_orderkey", "o_custkey")


@query(
    "WITH s AS (SELECT CASE WHEN vec_id % 10 <> 3 THEN vec_id END AS id, label, unnest(embedding) AS score, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT id AS vec_id, label, 'c' || k AS name, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score > 0 AND id IS NOT NULL"
)
def observations(spark, sf_dir):
    """One row for each class that a tag scores above nothing; rows without an identity give none."""
    e = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.expr("if(vec_id % 10 <> 3, vec_id, NULL)"))
    scores = e.select("vec_id", "label", F.posexplode("embedding").alias("k", "score")).where("score > 0 and vec_id is not null")
    return scores.select("vec_id", "label", F.concat(F.lit("c"), F.col("k").cast("string")).alias("name"), F.round(F.col("score").cast("double"), 6).alias("score"))


@query(
    "WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), z AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e FROM n), p AS (SELECT a.vec_id, a.e AS a, b.e AS b, sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) AS energy FROM z a JOIN z b ON b.vec_id = a.vec_id + 1), "
    "l AS (SELECT vec_id, lag, list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i + lag BETWEEN 1 AND len(b) THEN a[i] * b[i + lag] ELSE 0.0 END)) / energy AS score FROM p, (SELECT unnest(range(-16, 17)) AS lag)) "
    "SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(score, 6) AS peak FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, lag) = 1"
)
def clip_correlation(spark, sf_dir):
    """The shift at which each clip agrees best with the next one, and how well."""
    from echofold.operators import clips as C

    n = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = n.select(F.col("vec_id").alias("set"), F.lit(0).alias("node"), "embedding").unionByName(n.select((F.col("vec_id") - 1).alias("set"), F.lit(1).alias("node"), "embedding"))
    clips = both.select("set", "node", F.lit(0.0).alias("start_s"), F.lit(1.0).alias("fs"), F.col("embedding").cast("array<double>").alias("samples"))
    length = n.agg(F.max(F.size("embedding"))).first()[0] or 1
    delays = C.window_delays(clips, float(length), float(length), 16.0, between=False).where("node = 1")
    whole = delays.join(n.select(F.col("vec_id").alias("set")), "set", "left_semi")
    return whole.select(F.col("set").alias("vec_id"), F.col("delay_s").cast("int").alias("lag"), F.round("peak", 6).alias("peak"))


@query(
    f"WITH {DETS}, v AS (SELECT seq, node, t FROM d WHERE source = 'view'), e AS (SELECT seq, node, t FROM d WHERE source = 'purchase'), h AS (SELECT x.node, x.t FROM d x), "
    f"m AS (SELECT v.seq AS l_id, e.seq AS r_id, s.shift, abs(v.t + s.shift - e.t) AS error FROM v, (VALUES (-{3 * HOUR}), (-{2 * HOUR}), (-{HOUR}), ({HOUR}), ({2 * HOUR}), ({3 * HOUR})) s(shift), e WHERE v.node <> e.node AND abs(v.t + s.shift - e.t) <= {5 * MINUTE} "
    f"AND NOT EXISTS (SELECT 1 FROM h WHERE h.node = e.node AND abs(h.t - v.t) <= {30 * MINUTE})) SELECT l_id, r_id, shift, error FROM m QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY error, abs(shift), shift, r_id) = 1"
)
def whole_shift_suspects(spark, sf_dir):
    """Unused detections that would fit an event a whole number of units away, unless the event's own receiver heard something near where they are stamped."""
    from echofold.operators import matching as M

    d = detections(spark, sf_dir)
    unused = d.where("source = 'view'").select("seq", "node", "t")
    events = d.where("source = 'purchase'").select(F.col("seq").alias("r_id"), F.col("node").alias("r_node"), F.col("t").alias("r_t"))
    left = unused.select(F.col("seq").alias("l_id"), F.col("node").alias("l_node"), F.col("t").alias("l_t"))
    return M.vetoed_suspects(left, events, d.select("node", "t"), [k * HOUR for k in (-3, -2, -1, 1, 2, 3)], 5 * MINUTE, 30 * MINUTE)


@query(
    f"WITH {DETS}, o AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY t, seq) - 1 AS i, CASE WHEN seq % 29 = 0 THEN 100.0 ELSE value END AS v FROM d), h AS (SELECT node, i, coalesce(last_value(CASE WHEN v >= 30 THEN true WHEN v < 10 THEN false END IGNORE NULLS) OVER (PARTITION BY node ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS open FROM o), "
    "x AS (SELECT node, i, CASE WHEN coalesce(i - lag(i) OVER (PARTITION BY node ORDER BY i) > 2, true) THEN 1 ELSE 0 END AS new FROM h WHERE open), r AS (SELECT node, i, sum(new) OVER (PARTITION BY node ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM x), "
    "s AS (SELECT node, greatest(0, min(i) - 1) AS first, max(i) + 1 AS last FROM r GROUP BY node, run), e AS (SELECT node, max(i) AS most FROM o GROUP BY 1) SELECT s.node, first, least(last, most) AS last FROM s JOIN e USING (node) WHERE least(last, most) - first + 1 >= 4"
)
def speech_runs(spark, sf_dir):
    """Runs by hysteresis; short gaps are bridged, runs padded within the clip, and only then are short ones left out. What isn't a number counts as certain."""
    d = W.ordinals(detections(spark, sf_dir), ["node"], "t", "seq")
    v = d.withColumn("v", F.expr("if(seq % 29 = 0, double('NaN'), value)")).withColumn("v", F.when(F.isnan("v"), 100.0).otherwise(F.col("v"))).withColumn("i", F.col("ordinal").cast("long"))
    opened = W.hysteresis(v, ["node"], "i", "seq", "v", 30.0, 10.0)
    return S.bridged_runs(opened, ["node"], "i", F.col("open"), 2, 1, 4)


@query(
    f"WITH {DETS}, r AS (SELECT seq, node, t // {DAY} AS day, row_number() OVER (PARTITION BY node, t // {DAY} ORDER BY sha256(CAST(seq AS VARCHAR))) AS k, least(8, greatest(1, 1 + CAST(floor(value / 20) AS INTEGER))) AS band FROM d) SELECT seq, band, row_number() OVER (PARTITION BY node ORDER BY k, day) AS turn FROM r"
)
def round_robin_sample(spark, sf_dir):
    """Turns over nodes, within a node over days, and one of eight equal bands."""
    d = detections(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    out = S.in_turns(d, "node", "day", F.sha2(F.col("seq").cast("string"), 256))
    band = F.least(F.lit(8), F.greatest(F.lit(1), 1 + F.floor(F.col("value") / 20).cast("int")))
    return out.select("seq", band.alias("band"), F.col("turn").cast("long").alias("turn"))


@query(
    "WITH c AS (SELECT s_suppkey AS cand, s_nationkey % 4 = 0 AS collinear, round(s_acctbal, 2) AS dop FROM supplier) SELECT cand, rank() OVER (PARTITION BY cand % 10 ORDER BY collinear, dop) AS place FROM c"
)
def ranked_candidates(spark, sf_dir):
    """Candidates for a further receiver: those that leave the array on a line come last, then by precision; ties share a place."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cand"), (F.col("s_nationkey") % 4 == 0).alias("collinear"), F.round("s_acctbal", 2).alias("dop"))
    return c.select("cand", F.rank().over(Window.partitionBy(F.col("cand") % 10).orderBy("collinear", "dop")).cast("long").alias("place"))


@query(
    "WITH s AS (SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, max(event_id) AS total FROM events GROUP BY 1, 2), d AS (SELECT *, total - lag(total) OVER w AS grew, n - lag(n) OVER w AS delta FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)) "
    "SELECT user_id, count(*) AS n_samples, count(*) FILTER (grew < 0) AS n_backwards, coalesce(max(abs(delta)), 0) AS largest_step, coalesce(CAST(sum(delta) AS BIGINT), 0) AS net FROM d GROUP BY 1"
)
def soak_deltas(spark, sf_dir):
    """Differences of consecutive samples; a total that falls isn't conserved."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("total"))
    w = Window.partitionBy("user_id").orderBy("day")
    d = s.withColumns({"grew": F.col("total") - F.lag("total").over(w), "delta": F.col("n") - F.lag("n").over(w)})
    zero = F.lit(0).cast("long")
    return d.groupBy("user_id").agg(F.count("*").alias("n_samples"), F.count_if(F.col("grew") < 0).alias("n_backwards"), F.coalesce(F.max(F.abs("delta")), zero).alias("largest_step"), F.coalesce(F.sum("delta"), zero).alias("net"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 500 THEN 'done' ELSE 'deferred' END AS outcome FROM orders WHERE o_orderstatus = 'O'")
def bounded_run(spark, sf_dir):
    work = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return S.bounded_run(work, [F.desc("price"), "o_orderkey"], 500, "o_orderkey").select("o_orderkey", "o_custkey", "outcome")


@query(
    "WITH v AS (SELECT count(DISTINCT o_orderpriority) AS n_geometries, count(*) FILTER (o_totalprice < 2000) AS n_refused FROM orders) SELECT o_orderkey, n_geometries, n_refused FROM orders, v ORDER BY o_orderkey LIMIT 50"
)
def limit_after_validation(spark, sf_dir):
    """The limit holds for what is returned; all rows are validated."""
    o = table(spark, sf_dir, "orders")
    checked = o.agg(F.count_distinct("o_orderpriority").alias("n_geometries"), F.count_if(F.col("o_totalprice") < 2000).alias("n_refused"))
    return o.select("o_orderkey").orderBy("o_orderkey").limit(50).join(checked)


@query(
    "WITH g AS (SELECT n_nationkey, x, y, round(pow(x - n_nationkey % 7, 2) + pow(y - n_regionkey * 1.5, 2), 6) AS cost FROM nation, (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y)) SELECT n_nationkey, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, cost FROM g QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY cost, x, y) = 1"
)
def grid_argmin(spark, sf_dir):
    """The best cell of a grid for each source; ties go to the least x, then y."""
    cells = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    cost = F.round(F.pow(F.col("x") - F.col("n_nationkey") % 7, 2) + F.pow(F.col("y") - F.col("n_regionkey") * 1.5, 2), 6)
    best = cells.groupBy("n_nationkey").agg(F.min(F.struct(cost.alias("cost"), "x", "y")).alias("b"))
    return best.select("n_nationkey", "b.x", "b.y", "b.cost")


@query(
    "WITH s AS (SELECT 'orders' AS stream, o_orderkey AS position, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) * 9 // 10 FROM orders) UNION ALL SELECT 'events', event_id, epoch_us(ts) FROM events WHERE event_id <= (SELECT max(event_id) * 9 // 10 FROM events)) "
    "SELECT stream, t // 2592000000000 AS segment, count(*) AS n, min(position) AS first_position, max(position) AS last_position FROM s GROUP BY 1, 2"
)
def frozen_segments(spark, sf_dir):
    """Segments of two streams, each read up to a position frozen beforehand."""
    def frozen(rows):
        end = rows.agg(F.floor(F.max("position") * 9 / 10).alias("end"))
        return rows.join(end, F.col("position") <= F.col("end")).drop("end")

    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("stream"), F.col("o_orderkey").alias("position"), micros("o_orderdate").alias("t"))
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("stream"), F.col("event_id").alias("position"), micros("ts").alias("t"))
    both = frozen(o).unionByName(frozen(e))
    return both.groupBy("stream", F.floor(F.col("t") / 2592000000000).alias("segment")).agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


@query("SELECT kind, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT 'a' AS kind, o_custkey AS k FROM orders UNION ALL SELECT 'b', c_custkey FROM customer UNION ALL SELECT 'a', c_custkey FROM customer) GROUP BY 1")
def bag_union(spark, sf_dir):
    """A union that keeps repeats."""
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    parts = [o.withColumn("kind", F.lit("a")), c.withColumn("kind", F.lit("b")), c.withColumn("kind", F.lit("a"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"))


@query(
    "WITH s AS (SELECT n_name AS name, n_nationkey AS id, 'survey' AS origin FROM nation WHERE n_nationkey % 3 > 0), g AS (SELECT n_name AS name, 1000 + CAST('0x' || substr(md5(n_name), 1, 6) AS BIGINT) % 900 AS id, 'gps' AS origin, n_nationkey % 5 AS hacc, n_nationkey % 7 AS fixes FROM nation) "
    "SELECT * FROM s UNION ALL SELECT name, id, origin FROM g WHERE hacc <= 3 AND fixes >= 1 AND name NOT IN (SELECT name FROM s)"
)
def surveyed_or_gps(spark, sf_dir):
    """Surveyed receivers, and by their own fixes those that no survey knows and whose fixes are good enough."""
    n = table(spark, sf_dir, "nation")
    s = n.where("n_nationkey % 3 > 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"), F.lit("survey").alias("origin"))
    number = 1000 + F.conv(F.substring(F.md5("n_name"), 1, 6), 16, 10).cast("long") % 900
    g = n.where("n_nationkey % 5 <= 3 and n_nationkey % 7 >= 1").select(F.col("n_name").alias("name"), number.alias("id"), F.lit("gps").alias("origin"))
    return s.unionByName(g.join(s.select("name"), "name", "left_anti"))


@query(
    "WITH n AS (SELECT n_nationkey * 3.0 AS x, n_regionkey * 7.0 AS y FROM nation), p AS (SELECT max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM n a, n b) SELECT round(m, 6) AS diameter_m, round(m / 343.42 + 0.03, 9) AS window_s FROM p"
)
def window_from_survey(spark, sf_dir):
    """The longest time that sound takes across the array, plus the margin; never a constant."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3.0).alias("x"), (F.col("n_regionkey") * 7.0).alias("y"))
    a, b = n.alias("a"), n.alias("b")
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    m = a.join(b, F.col("a.x") <= F.col("b.x")).agg(F.max(d).alias("m"))
    return m.select(F.round("m", 6).alias("diameter_m"), F.round(F.col("m") / 343.42 + 0.03, 9).alias("window_s"))


@query(
    "WITH n AS (SELECT n_nationkey % 5 * 20.0 AS x, n_regionkey * 25.0 AS y FROM nation), c AS (SELECT unnest(range(0, 20)) AS i), g AS (SELECT a.i AS i, b.i AS j FROM c a, c b), "
    "u AS (SELECT i, j, (i * 10.0 - 45 - x) / greatest(sqrt(pow(i * 10.0 - 45 - x, 2) + pow(j * 10.0 - 35 - y, 2)), 1e-9) AS u, (j * 10.0 - 35 - y) / greatest(sqrt(pow(i * 10.0 - 45 - x, 2) + pow(j * 10.0 - 35 - y, 2)), 1e-9) AS v FROM g, n), "
    "s AS (SELECT i, j, sum(u*u) - sum(u)*sum(u)/count(*) AS a, sum(v*v) - sum(v)*sum(v)/count(*) AS b, sum(u*v) - sum(u)*sum(v)/count(*) AS c FROM u GROUP BY 1, 2), d AS (SELECT sqrt((a + b) / (a*b - c*c)) AS dop FROM s WHERE abs(a*b - c*c) >= 1e-12) "
    "SELECT count(*) AS n_cells, round(median(dop), 4) AS median_dop, round(quantile_cont(dop, 0.95), 4) AS p95_dop, round(count(*) FILTER (dop < 2) / count(*), 6) AS usable FROM d"
)
def dop_grid(spark, sf_dir):
    """How well an array locates sources over a grid of cells."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5 * 20.0).alias("x"), (F.col("n_regionkey") * 25.0).alias("y"))
    side = F.sequence(F.lit(0), F.lit(19))
    cells = spark.range(1).select(F.explode(side).alias("i")).select("i", F.explode(side).alias("j"))
    d = S.dilution(F.col("i") * 10.0 - 45, F.col("j") * 10.0 - 35, n, cells, ["i", "j"]).where("dop is not null")
    return d.agg(F.count("*").alias("n_cells"), F.round(F.median("dop"), 4).alias("median_dop"), F.round(F.percentile("dop", F.lit(0.95)), 4).alias("p95_dop"), F.round(F.count_if(F.col("dop") < 2) / F.count("*"), 6).alias("usable"))


@query(
    f"WITH RECURSIVE {DETS}, k AS (SELECT node, source, t, row_number() OVER (PARTITION BY node, source ORDER BY t, seq) AS i FROM d), r AS (SELECT node, source, t, i, t AS last, true AS accepted FROM k WHERE i = 1 "
    f"UNION ALL SELECT k.node, k.source, k.t, k.i, CASE WHEN k.t - r.last > {8 * HOUR} THEN k.t ELSE r.last END, k.t - r.last > {8 * HOUR} FROM r JOIN k ON k.node = r.node AND k.source = r.source AND k.i = r.i + 1) SELECT node, source, t, accepted FROM r"
)
def repeats_within_window(spark, sf_dir):
    """A repeat within the window of the last accepted copy isn't accepted; chains of repeats need what came before."""
    from echofold.operators.association import first_copies

    return first_copies(detections(spark, sf_dir).select("node", "source", "t"), ["node", "source"], "t", 8 * HOUR)
