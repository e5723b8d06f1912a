"""First and last wins, reconciliation of two surfaces, digests, suppressed aggregates, slices and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.scratch import sized

UNIT = "\u001f"


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, by a partial aggregation in each task and a final one. A struct has no buffer that Spark can change in place, so tasks sort by key; none sorts a key's rows by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*order, *rest)])


def first_wins(df: DataFrame, keys: list[str], order: list[str], body: str, hot_keys: bool = False) -> DataFrame:
    """Per key: the first body, arrivals, repeats of it, and arrivals whose body differs from it.

    One shuffle by key, where each key's rows pass in order; the larger the input, the more tasks. With ``hot_keys`` bodies are counted where they are read, then per key: two shuffles, the second of one row a body, and
    no key's rows in one task.
    """
    if hot_keys:
        bodies = df.groupBy(*keys, body).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_at"))
        first = F.min_by("_n", "_at")
        return bodies.groupBy(*keys).agg(F.min_by(body, "_at").alias("body"), F.sum("_n").alias("arrivals"), (first - 1).alias("duplicates"), (F.sum("_n") - first).alias("conflicts"))
    df = sized(df, *keys)
    passing = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(body).eqNullSafe(F.col("_first"))
    rows = df.withColumn("_first", F.first(body).over(passing))
    return rows.groupBy(*keys).agg(F.any_value("_first").alias("body"), F.count(F.lit(1)).alias("arrivals"), (F.count_if(same) - 1).alias("duplicates"), F.count_if(~same).alias("conflicts"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], rules) -> DataFrame:
    """Full outer join of two surfaces; ``rules(l, r)`` gives ordered (condition, class) pairs for rows that both have."""
    from echofold.operators.classify import first_reason

    l, r = left.withColumn("_in_l", F.lit(True)).alias("l"), right.withColumn("_in_r", F.lit(True)).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    both = l.join(r, on, "full_outer")
    known = [(F.col("r._in_r").isNull(), "missing"), (F.col("l._in_l").isNull(), "extra")]
    verdict = first_reason([*known, *rules(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))], "match")
    return both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], verdict.alias("verdict"))


def nearest_index(sorted_values: Column, fraction: float) -> Column:
    """The element at floor(f * n) of a sorted array, the last at most; null if empty."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.element_at(sorted_values, F.least(n, F.floor(n * F.lit(fraction)).cast("int") + 1)))


def nearest_index_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-index percentiles by rank, so that no group is gathered in one row.

    The rank comes from counts per distinct value: a group's hottest value costs one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_to": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    picks = []
    for name, f in fractions.items():
        place = F.least(F.col("_all"), F.floor(F.col("_all") * F.lit(f)) + 1)
        picks.append(F.max(F.when((F.col("_to") >= place) & (F.col("_to") - F.col("_n") < place), F.col(value))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_all").alias("n"), *picks)


def set_digest(values: Column) -> Column:
    """Digest of a set of strings, whatever their order and number."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(values)), UNIT), 256)


def sequence_digest(order: Column, values: Column) -> Column:
    """Digest of strings in the order given."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["v"]), UNIT), 256)


def suppressed(cells: DataFrame, count: str, least: int, *values: str) -> DataFrame:
    """Cells of fewer than ``least`` rows lose their values and say so."""
    small = F.col(count) < least
    return cells.withColumns({v: F.when(~small, F.col(v)) for v in (count, *values)} | {"is_suppressed": small})


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float, least: int) -> DataFrame:
    """Verdict of two aggregates (keys, n, value) cell by cell; cells small on either side aren't compared."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    verdict = (
        F.when(F.col("b.n").isNull(), "missing")
        .when(F.col("a.n").isNull(), "extra")
        .when((F.col("a.n") < least) | (F.col("b.n") < least), "suppressed")
        .when(F.col("a.n") != F.col("b.n"), "count_differs")
        .when(F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) > tolerance, "value_differs")
        .otherwise("match")
    )
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], verdict.alias("verdict"))


def sampled(df: DataFrame, key: Column, denominator: int) -> DataFrame:
    """One row in ``denominator``, by the key's SHA-256: the same rows on every run and every cluster."""
    return df.where(F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(denominator)) == 0)


def page_after(df: DataFrame, sort: str, tie: str, after: tuple | None, size: int) -> DataFrame:
    """Keyset page of ``size`` rows (the feature) in the total order (sort, tie)."""
    if after is not None:
        df = df.where((F.col(sort) > F.lit(after[0])) | ((F.col(sort) == F.lit(after[0])) & (F.col(tie) > F.lit(after[1]))))
    return df.orderBy(sort, tie).limit(size)


def rank_slices(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Slice number of each row within its key, ``size`` rows a slice."""
    return df.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def ack_through(df: DataFrame, keys: list[str], index: str, status: str) -> DataFrame:
    """Last index before the first deferred item of each batch."""
    first_deferred = F.min(F.when(F.col(status) == "deferred", F.col(index)))
    return df.groupBy(*keys).agg(F.coalesce(first_deferred - 1, F.max(index)).alias("ack_through"), F.count(F.lit(1)).alias("submitted"))


def histogram(df: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Cumulative counts by upper edge, one row per key and edge, with infinity as null."""
    sums = [F.sum(F.when(F.col(value) <= e, 1).otherwise(0)).alias(f"_le{i}") for i, e in enumerate(edges)]
    agg = df.groupBy(*keys).agg(*sums, F.count(value).alias("_all"))
    cells = [F.struct(F.lit(float(e)).alias("le"), F.col(f"_le{i}").alias("n")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))
    return agg.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.le", "c.n")


def running_cap(df: DataFrame, keys: list[str], order: list[str], weight: str, cap: float) -> DataFrame:
    """Adds is_kept: rows in order until their running weight passes the cap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("is_kept", F.sum(weight).over(w) <= cap)
