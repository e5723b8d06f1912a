"""Queries on time horizons, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from echofold.operators.classify import tally
from echofold.plans.tables import DETS, HOUR, detections
from echofold.streaming import horizons as H

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(
    f"WITH {DETS}, a AS (SELECT (SELECT max(t) FROM d) - t AS age, source = 'purchase' AS emitted FROM d) "
    f"SELECT CASE WHEN age IS NULL THEN 'unanchored' WHEN age < {2 * HOUR} THEN 'pending_settle' WHEN age > {72 * HOUR} AND emitted THEN 'lookback_emitted' "
    f"WHEN age > {72 * HOUR} THEN 'lookback_lost' ELSE 'admitted' END AS reason, count(*) AS n FROM a GROUP BY 1"
)
def horizon_tally(spark, sf_dir):
    d = detections(spark, sf_dir)
    age = F.col("now") - F.col("t")
    return tally(d.join(d.agg(F.max("t").alias("now"))).select(H.horizon_class(age, F.col("source") == "purchase", 2 * HOUR, 72 * HOUR).alias("reason")))


@query(f"WITH {DETS} SELECT node, source, max(seq) AS position, count(*) AS n_rows FROM d GROUP BY 1, 2")
def cursor_positions(spark, sf_dir):
    return H.cursor_positions(detections(spark, sf_dir), ["node", "source"], "seq")
