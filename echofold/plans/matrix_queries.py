"""Queries that build matrices of features, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.functions import acoustics as A
from echofold.plans.tables import DETS, HOUR, detections, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Rate of a record: most state one of two.
RATE = "CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 8000 ELSE 16000 END"


@query(f"SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / 2 - 3.0, 6)) AS x FROM (SELECT *, {RATE} AS fs FROM embeddings) WHERE fs = 16000")
def feature_rows(spark, sf_dir):
    """Features of the records at one rate, a step being half a decibel over the reference."""
    e = table(spark, sf_dir, "embeddings").withColumn("fs", F.expr(RATE))
    return e.where("fs = 16000").select("vec_id", F.transform("embedding", lambda x: A.rounded(x.cast("double") / 2 - 3.0, 6)).alias("x"))


@query(
    f"WITH e AS (SELECT *, {RATE} AS fs FROM embeddings) SELECT count(*) AS n_in, count(*) FILTER (fs = 16000) AS n_kept, count(*) FILTER (fs IS NULL) AS n_no_rate, count(*) FILTER (fs <> 16000) AS n_other, count(DISTINCT len(embedding)) FILTER (fs = 16000) AS n_widths, min(fs) FILTER (fs <> 16000) AS nearest_dropped FROM e"
)
def feature_info(spark, sf_dir):
    """What a feature matrix leaves out; kept, without a rate and at other rates make all."""
    e, fs = table(spark, sf_dir, "embeddings").withColumn("fs", F.expr(RATE)), F.col("fs")
    return e.agg(F.count("*").alias("n_in"), F.count_if(fs == 16000).alias("n_kept"), F.count_if(fs.isNull()).alias("n_no_rate"), F.count_if(fs != 16000).alias("n_other"), F.count_distinct(F.when(fs == 16000, F.size("embedding"))).alias("n_widths"), F.min(F.when(fs != 16000, fs)).alias("nearest_dropped"))


#: Bands of a fixed layout, from 100 Hz to 8 kHz in equal ratios, and frames of a record.
BANDS, FRAMES, LOW, HIGH = 16, 4, 100.0, 8000.0
_EDGES = "[" + ", ".join(repr(LOW * (HIGH / LOW) ** (k / BANDS)) for k in range(1, BANDS + 1)) + "]"


@query(
    f"WITH e AS (SELECT vec_id, embedding, {RATE} AS fs FROM embeddings), v AS (SELECT *, len(list_filter({_EDGES}, lambda x: x <= fs / 2 + 1e-6)) AS bands FROM e WHERE fs IS NOT NULL), k AS (SELECT min(bands) AS k FROM v) "
    f"SELECT vec_id, CAST(k AS INTEGER) AS n_bands, CAST(bands - k AS INTEGER) AS n_dropped, list_transform(embedding[1:k * {FRAMES}], lambda x: round(CAST(x AS DOUBLE), 6)) AS x FROM v, k"
)
def aligned_rows(spark, sf_dir):
    """Records of several rates cut to the bands that lie below half the rate of all of them, by the bands' upper edges; records without a rate can't be aligned."""
    edges = F.array(*[F.lit(LOW * (HIGH / LOW) ** (k / BANDS)) for k in range(1, BANDS + 1)])
    v = table(spark, sf_dir, "embeddings").withColumn("fs", F.expr(RATE)).where("fs is not null").withColumn("bands", F.size(F.filter(edges, lambda x: x <= F.col("fs") / 2 + 1e-6)))
    k = v.agg(F.min("bands").alias("k"))
    whole = F.transform(F.slice("embedding", F.lit(1), F.col("k") * FRAMES), lambda x: A.rounded(x.cast("double"), 6))
    return v.join(k).select("vec_id", F.col("k").alias("n_bands"), (F.col("bands") - F.col("k")).alias("n_dropped"), whole.alias("x"))


@query(
    "WITH g AS (SELECT label, count(DISTINCT len(embedding)) AS n FROM embeddings GROUP BY 1) SELECT vec_id, label, CASE WHEN n = 1 AND label % 4 <> 2 THEN list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) END AS x, CASE WHEN n > 1 OR label % 4 = 2 THEN 'mixed_geometry' END AS refusal FROM embeddings JOIN g USING (label)"
)
def scene_rows(spark, sf_dir):
    """Rows of a group whose members share one geometry; else the group is refused as a whole."""
    e = table(spark, sf_dir, "embeddings")
    geometry = F.when(F.col("label") % 4 == 2, F.col("vec_id")).otherwise(F.size("embedding"))
    g = e.groupBy("label").agg((F.count_distinct(geometry) > 1).alias("mixed"))
    return e.join(g, "label").select("vec_id", "label", F.when(~F.col("mixed"), F.transform("embedding", lambda x: A.rounded(x.cast("double"), 6))).alias("x"), F.when(F.col("mixed"), "mixed_geometry").alias("refusal"))


@query(f"WITH {DETS} SELECT node, t / 1000000.0 AS t_s, value AS x FROM d WHERE seq % 53 <> 1")
def anchored_series(spark, sf_dir):
    """(X, t) of the rows with an anchor."""
    return detections(spark, sf_dir).where("seq % 53 <> 1").select("node", (F.col("t") / 1000000.0).alias("t_s"), F.col("value").alias("x"))


@query(
    "WITH n AS (SELECT vec_id, len(embedding) AS n, 16 AS w, 10 AS hop FROM embeddings), s AS (SELECT vec_id, n, w, list_sort(list_distinct(list_concat(list_transform(range(0, (n - w) // hop + 1), lambda k: k * hop), [(n - w) // 2]))) AS starts FROM n) SELECT vec_id, starts, CAST(len(starts) AS INTEGER) AS n_windows FROM s"
)
def dense_windows(spark, sf_dir):
    """Starts of windows every hop and of the one in the middle, each once."""
    n = F.size("embedding")
    hops = F.transform(F.sequence(F.lit(0), F.floor((n - 16) / 10)), lambda k: k * 10)
    starts = F.array_sort(F.array_union(hops, F.array(F.floor((n - 16) / 2))))
    return table(spark, sf_dir, "embeddings").select("vec_id", starts.alias("starts"), F.size(starts).alias("n_windows"))


@query(
    "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT k, avg(CAST(x AS DOUBLE)) AS a, stddev_pop(CAST(x AS DOUBLE)) AS s FROM e GROUP BY 1), d AS (SELECT vec_id, label, sqrt(sum(pow((x - a) / s, 2))) AS d FROM e JOIN m USING (k) GROUP BY 1, 2) "
    "SELECT label, count(*) AS n, round(avg(d), 4) AS mean_distance FROM d GROUP BY 1"
)
def scaled_distances(spark, sf_dir):
    """Distance of vectors from the whole table's centre, each axis in its own deviation."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    # One row, as wide as a vector.
    axes = e.select(F.posexplode("e").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s"))
    m = axes.agg(F.array_sort(F.collect_list(F.struct("k", "a", "s"))).alias("m"))
    d = F.sqrt(F.aggregate(F.zip_with("e", "m", lambda x, m: F.pow((x - m["a"]) / m["s"], F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    return e.join(F.broadcast(m)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean_distance"))


@query(None)
def anomaly_scores(spark, sf_dir):
    """Distance of each vector from its class's centre in the class's covariance over all axes, learnt from the rows that aren't held out, and whether it is an outlier for its class."""
    from echofold.operators import fusion

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("x"))
    held = F.crc32(F.col("vec_id").cast("string")) % 5 == 0
    fits = fusion.gaussian_fit(rows.where(~held), "class", "x", shrinkage=0.05)
    out = fusion.gaussian_distance(rows, fits, "class", "x")
    return out.select("vec_id", held.alias("held_out"), F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), (F.col("distance") > F.col("threshold")).alias("outlier"))
