"""Counts, samples and limits over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_index(values: Column, n: Column, fraction: float, most: int = 0) -> Column:
    """Element int(fraction * (n - most)) of an ascending array, counted from 0."""
    return F.get(values, F.floor(fraction * (n - most)).cast("int"))


def total_order(rows: DataFrame, sort: Sequence[str], tie: str | None) -> list[Column]:
    """The order by ``sort`` and a unique ``tie``; refused without one, as pages of it wouldn't be repeatable."""
    if tie is None or tie not in rows.columns:
        raise ValueError("an order needs a unique column that breaks ties")
    return [F.col(c) for c in sort] + ([] if tie in sort else [F.col(tie)])


def bounded_run(work: DataFrame, order: Sequence[str], limit: int, on: str) -> DataFrame:
    """``work`` with ``outcome``: done for the first ``limit`` rows in the order, deferred for the rest. ``on`` is unique."""
    first = work.orderBy(*order).limit(limit).select(on, F.lit("done").alias("outcome"))
    return work.join(first, on, "left").withColumn("outcome", F.coalesce("outcome", F.lit("deferred")))


def kept_under_cap(rows: DataFrame, group: Sequence[str], order: str, cap: int) -> DataFrame:
    """The rows left after the oldest row of the group with most rows goes, over and over, until ``cap`` are left; of equal groups the one with the newest row loses first.

    A row goes when its group is as large as its rank from the newest, so the outcome is an order: no loop is needed.
    """
    newest = Window.partitionBy(*group)
    ranked = rows.withColumn("_rank", F.row_number().over(newest.orderBy(F.desc(order)))).withColumn("_newest", F.max(order).over(newest))
    return ranked.orderBy("_rank", "_newest").limit(cap).drop("_rank", "_newest")


def last_above(acf: DataFrame, key: Sequence[str], rho: float, min_pairs: int = 1) -> DataFrame:
    """Per key: the largest lag whose ``acf`` is at least ``rho``, and whether it is the largest measured, so that the true one may lie beyond."""
    known = acf.where(F.col("n_pairs") >= min_pairs)
    out = known.groupBy(*key).agg(F.max(F.when(F.col("acf") >= rho, F.col("lag"))).alias("decorrelation_lag"), F.max("lag").alias("_most"))
    return out.withColumn("is_censored", F.coalesce(F.col("decorrelation_lag") == F.col("_most"), F.lit(False))).drop("_most")


def bridged_runs(rows: DataFrame, by: Sequence[str], index: str, is_open: Column, bridge: int, pad: int, least: int) -> DataFrame:
    """Runs of open samples (by, index consecutive within it): gaps of up to ``bridge`` samples are bridged, then ``pad`` samples added on both sides within
    the clip, and only then are runs below ``least`` samples left out. Returns by, first, last."""
    order = Window.partitionBy(*by).orderBy(index)
    ends = rows.groupBy(*by).agg(F.max(index).alias("_end"))
    opened = rows.where(is_open).withColumn("_new", (F.coalesce(F.col(index) - F.lag(index).over(order) > bridge, F.lit(True))).cast("int"))
    runs = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_run").agg(F.min(index).alias("a"), F.max(index).alias("b"))
    out = runs.join(ends, list(by)).select(*by, F.greatest(F.lit(0), F.col("a") - pad).alias("first"), F.least(F.col("_end"), F.col("b") + pad).alias("last"))
    return out.where(F.col("last") - F.col("first") + 1 >= least)


def in_turns(rows: DataFrame, outer: str, inner: str, order: Column) -> DataFrame:
    """``rows`` with ``turn``: outer groups (nodes) give a row each in every turn, and within one its inner groups (days) take turns."""
    first = rows.withColumn("_order", order)
    first = first.withColumn("_round", F.row_number().over(Window.partitionBy(outer, inner).orderBy("_order")))
    return first.withColumn("turn", F.row_number().over(Window.partitionBy(outer).orderBy("_round", inner))).drop("_order", "_round")


def dilution(east: Column, north: Column, receivers: DataFrame, cells: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Horizontal dilution of precision at each cell: sqrt of the trace of the inverse of unit vectors' centred products; null where that is singular.

    ``receivers`` (x, y) is a survey: every cell is joined with all of it.
    """
    d = F.sqrt(F.pow(east - F.col("x"), 2) + F.pow(north - F.col("y"), 2))
    rows = cells.join(receivers).withColumn("_d", F.greatest(d, F.lit(1e-9)))
    rows = rows.withColumns({"_u": (east - F.col("x")) / F.col("_d"), "_v": (north - F.col("y")) / F.col("_d")})
    sums = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_u").alias("su"), F.sum("_v").alias("sv"), F.sum(F.col("_u") * F.col("_u")).alias("suu"), F.sum(F.col("_v") * F.col("_v")).alias("svv"), F.sum(F.col("_u") * F.col("_v")).alias("suv")
    )
    a, b, c = F.col("suu") - F.col("su") * F.col("su") / F.col("n"), F.col("svv") - F.col("sv") * F.col("sv") / F.col("n"), F.col("suv") - F.col("su") * F.col("sv") / F.col("n")
    det = a * b - c * c
    return sums.select(*cell, F.when(F.abs(det) >= 1e-12, F.sqrt((a + b) / det)).alias("dop"))


def correlation_lag(a: Column, b: Column, most: int) -> Column:
    """The shift of ``b`` against ``a`` (arrays of equal size), up to ``most`` either way, with the largest sum of products; the least shift among equals."""
    def at(lag):
        pairs = F.transform(a, lambda x, i: x.cast("double") * F.coalesce(F.get(b, (i + lag).cast("int")).cast("double"), F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    shifts = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda lag: F.struct(F.round(at(lag), 6).alias("score"), (-F.abs(lag)).alias("near"), lag.alias("lag")))
    return F.array_max(shifts)["lag"]
