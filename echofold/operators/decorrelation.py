"""How far apart in time rows of a series stop looking like each other, and whether blocks can be sized by it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.scratch import spread, written


#: Rows of a series, and bytes of their vectors, in a block.
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 24


def interpolated_percentile(rows: DataFrame, keys: list[str], value: str, fraction: float, name: str, times: str | None = None) -> DataFrame:
    """(keys, name): the percentile between the two nearest ranks, from counts per distinct value, so that no group is gathered. A row counts once, or ``times``."""
    count = F.count(F.lit(1)) if times is None else F.sum(times)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_to": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    place = (F.col("_all") - 1) * F.lit(fraction)
    holds = lambda rank: (F.col("_to") > rank) & (F.col("_to") - F.col("_n") <= rank)
    found = ranked.groupBy(*keys).agg(F.max(F.when(holds(F.floor(place)), F.col(value))).alias("_a"), F.max(F.when(holds(F.ceil(place)), F.col(value))).alias("_b"), F.max(place - F.floor(place)).alias("_w"))
    return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(name))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _by_separation(z: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, k, sep, n, cos, ll): what the pairs of rows (s, i from 0 without a gap, t, z, norm, lev) ``k`` places apart come to for each difference of times, for series (s, n, dt, ks, block).

    A task reads a block of rows, and then one after the other all earlier rows that some lag leads there.
    """
    rows = z.join(asked.select("s", "n", "ks", "block"), "s")
    block = lambda i: F.floor(i / F.col("block"))
    reached = F.transform(F.filter("ks", lambda k: F.col("i") + k < F.col("n")), lambda k: block(F.col("i") + k))
    met = F.when(F.col("norm") > 0, F.array_distinct(reached)).otherwise(F.array().cast("array<bigint>"))
    place = lambda b, side: F.struct(b.alias("cell"), F.lit(side).alias("side"))
    both = F.explode(F.concat(F.array(place(block(F.col("i")), 1)), F.transform(met, lambda b: place(b, 2)))).alias("p")
    values = ["i", "t", "norm", "lev", "z"]
    dealt = rows.select("s", *values, both).select("s", "p.cell", "p.side", *values, F.lit(None).cast("double").alias("dt"), F.lit(None).cast("array<int>").alias("ks"))
    # What holds for all of a block's rows comes once, before them.
    cells = F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("n") - 1))).alias("cell")
    none = [F.lit(None).cast(z.schema[c].dataType).alias(c) for c in values[1:]]
    heads = asked.select("s", cells, "block", "dt", "ks").select("s", "cell", F.lit(0).alias("side"), (F.col("cell") * F.col("block")).alias("i"), *none, "dt", "ks")
    dealt = spread(heads.unionByName(dealt), "s", "cell").sortWithinPartitions("s", "cell", "side", "i")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for batch in batches:
            s, at, side = (batch.column(c).to_numpy() for c in ("s", "cell", "side"))
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(at) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):
                if a == b:
                    continue
                if (s[a], at[a]) != now:
                    yield from cell.sums() if cell else ()
                    now, cell = (s[a], at[a]), _Block(batch.slice(a, 1).to_pylist()[0])
                if side[a] > 0:
                    cell.add(batch.slice(a, b - a), side[a] == 2)
        yield from cell.sums() if cell else ()

    return dealt.mapInArrow(solve, "s long, k int, sep double, n long, cos double, ll double")


class _Block:
    """A block of a series' rows, and its pairs with earlier ones so far."""

    def __init__(self, head: dict):
        self.s, self.first, self.dt, self.ks = head["s"], head["i"], head["dt"], head["ks"]
        self.late, self.own, self.pairs = [], None, {k: [] for k in self.ks}

    def add(self, batch: pa.RecordBatch, early: bool) -> None:
        rows = [batch.column(c).to_numpy() for c in ("i", "t", "norm", "lev")] + [batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)]
        if not early:
            self.late.append(rows)
            return
        if self.own is None:
            self.own, self.late = [np.concatenate(c) for c in zip(*self.late)], []
        i, t, norm, lev, z = rows
        _, at, own_norm, own_lev, own_z = self.own
        for k in self.ks:
            a, b = np.searchsorted(i, [self.first - k, self.first + len(at) - k])
            if a == b:
                continue
            there, here = i[a:b] + k - self.first, np.arange(a, b)
            sep = at[there] - t[here]
            good = (own_norm[there] > 0) & (sep >= 0.5 * k * self.dt) & (sep <= 1.5 * k * self.dt)
            there, here, sep = there[good], here[good], sep[good]
            if len(there):
                # Axes are added in their order.
                dot = np.cumsum(z[here] * own_z[there], axis=1)[:, -1]
                self.pairs[k].append((sep, dot / (norm[here] * own_norm[there]), lev[here] * own_lev[there]))

    def sums(self) -> Iterator[pa.RecordBatch]:
        for k, parts in self.pairs.items():
            if parts:
                sep, cos, ll = (np.concatenate(c) for c in zip(*parts))
                values, place, n = np.unique(sep, return_inverse=True, return_counts=True)
                size = len(values)
                columns = [pa.array(np.full(size, self.s, np.int64)), pa.array(np.full(size, k, np.int32)), pa.array(values), pa.array(n.astype(np.int64)), pa.array(np.bincount(place, cos, size)), pa.array(np.bincount(place, ll, size))]
                yield pa.RecordBatch.from_arrays(columns, ["s", "k", "sep", "n", "cos", "ll"])


def decorrelation(series: DataFrame, key: str, t: str, vector: str, rho: float = 0.5, n_lags: int = 48, min_pairs: int = 8, max_lag_s: float | None = None) -> DataFrame:
    """The lag of each series (key, t in seconds, vector) behind the last at which its rows are still alike.

    For row lags in equal ratios up to a quarter of the span (or ``max_lag_s``), over the pairs so far apart whose times differ by half to one and a half times as many intervals: the mean
    cosine of the rows less the mean row (direction), and the autocorrelation of their lengths (level). The larger one counts. The lag is that after the last with ``rho`` or more; if that is the longest measured,
    the result is censored and the lag is the bound. Returns key, n, dt_s, lag_s, lag_rows, n_pairs, statistic, channel, censored and refusal: ``not_finite``, ``mixed_sizes``,
    ``too_few_rows``, ``no_span``, ``lag_too_short`` or ``no_pairs``.

    Rows without a time, or at 0 and before, have no anchor and take no part; equal times are ordered by the vector. A series is cut into blocks of rows
    (``_by_separation``): a row is shuffled once for its own and once for each block that one of the lags leads it to.
    """
    rows = series.select(F.col(key).alias("g"), F.col(t).cast("double").alias("t"), F.col(vector).cast("array<double>").alias("v"))
    keys = rows.select("g").distinct()
    rows = rows.where((F.col("t") > 0) & (F.col("t") < float("inf")))
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ordered = Window.partitionBy("g").orderBy("t", "v")
    rows = written(rows.withColumns({"i": F.row_number().over(ordered) - 1, "gap": F.col("t") - F.lag("t").over(ordered), "bad": bad}))
    facts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"), F.bool_or("bad").alias("bad"), F.count_distinct(F.size("v")).alias("sizes"), F.max(F.size("v")).alias("axes"))
    facts = facts.join(interpolated_percentile(rows.where("gap > 0"), ["g"], "gap", 0.5, "dt"), "g", "left")
    cap = F.col("span") / 4 if max_lag_s is None else F.lit(float(max_lag_s))
    refusal = (
        F.when(F.col("n").isNull() | (F.col("n") < 3), "too_few_rows").when(F.col("bad"), "not_finite").when(F.col("sizes") > 1, "mixed_sizes").when(~(F.col("span") > 0), "no_span")
        .when((F.floor(cap / F.col("dt")) < 1) | (F.col("n") < 3), "lag_too_short")
    )
    facts = written(keys.join(facts, "g", "left").withColumns({"cap": cap, "refusal": refusal, "most": F.least(F.floor(cap / F.col("dt")), F.col("n") - 2), "s": F.monotonically_increasing_id()}))
    good = facts.where("refusal is null").select("g", "s", "n", "dt", "most", "axes")
    step = lambda j: F.when(j == 0, F.lit(1)).when(j == n_lags - 1, F.col("most")).otherwise(F.bround(F.exp(F.ln("most") * j / (n_lags - 1))))
    ks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_lags - 1)), lambda j: step(j).cast("int")))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / 8 / F.greatest("axes", F.lit(1))))).cast("long")
    asked = good.select("g", "s", "n", "dt", ks.alias("ks"), block.alias("block"))
    used = rows.join(good.select("g", "s"), "g")
    # As many rows as a series' vectors have axes.
    means = used.select("g", F.posexplode("v").alias("j", "x")).groupBy("g", "j").agg(F.avg("x").alias("m")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda r: r["m"]).alias("mean"))
    z = used.join(means, "g").withColumn("z", F.zip_with("v", "mean", lambda x, m: x - m))
    z = z.withColumn("norm", F.sqrt(_dot(F.col("z"), F.col("z")))).select("g", "s", "i", "t", "z", "norm")
    level = written(z.groupBy("g").agg(F.avg("norm").alias("level"), F.var_pop("norm").alias("spread")))
    z = written(z.join(level.select("g", "level"), "g").select("s", F.col("i").cast("long").alias("i"), "t", "z", "norm", (F.col("norm") - F.col("level")).alias("lev")))
    pairs = written(_by_separation(z, asked)).join(good.select("g", "s"), "s")
    mean = lambda c: F.sum(c) / F.sum("n")
    curve = pairs.groupBy("g", "k").agg(F.sum("n").alias("n_pairs"), mean("cos").alias("direction"), mean("ll").alias("ll")).where(F.col("n_pairs") >= min_pairs).join(level.select("g", "spread"), "g")
    curve = curve.withColumn("level", F.when(F.col("spread") > 0, F.col("ll") / F.col("spread")).otherwise(0.0)).withColumn("statistic", F.greatest("direction", "level"))
    curve = curve.join(interpolated_percentile(pairs, ["g", "k"], "sep", 0.5, "lag_s", "n"), ["g", "k"])
    # At most n_lags rows a series.
    in_order = Window.partitionBy("g").orderBy("k")
    curve = curve.withColumn("place", F.row_number().over(in_order))
    last = curve.groupBy("g").agg(F.max(F.when(F.col("statistic") >= rho, F.col("place"))).alias("above"), F.max("place").alias("end"))
    marked = curve.join(last, "g").withColumn("above", F.coalesce("above", F.lit(0)))
    hit = marked.where("place = above + 1").select("g", F.col("lag_s").alias("h_s"), F.col("k").alias("h_k"), "n_pairs", "statistic")
    channel = marked.where("place = above").select("g", F.when(F.col("level") >= F.col("direction"), "level").otherwise("direction").alias("channel"))
    out = facts.join(last.select("g", (F.coalesce("above", F.lit(0)) >= F.col("end")).alias("censored")), "g", "left").join(hit, "g", "left").join(channel, "g", "left")
    out = out.withColumn("refusal", F.coalesce("refusal", F.when(F.col("censored").isNull(), "no_pairs")))
    lag = F.when(F.col("censored"), F.col("cap")).otherwise(F.col("h_s"))
    return out.select(F.col("g").alias(key), F.coalesce("n", F.lit(0)).alias("n"), F.col("dt").alias("dt_s"), lag.alias("lag_s"), F.when(F.col("censored"), F.col("most")).otherwise(F.col("h_k")).cast("long").alias("lag_rows"), "n_pairs", "statistic", "channel", "censored", "refusal")


def block_gates(lags: DataFrame, spans: DataFrame, key: str, multiple: float = 3.0, least_blocks: int = 7) -> DataFrame:
    """Whether series (``decorrelation``) with their spans (key, span_s) can be cut into blocks of ``multiple`` lags: block_s, n_blocks and gate.

    ``pass``, the refusal, ``censored_lag`` (a bound sizes no block) or ``too_few_blocks``.
    """
    block = F.col("lag_s") * multiple
    rows = lags.join(spans.select(key, "span_s"), key, "left").withColumn("block_s", F.when(F.col("refusal").isNull() & ~F.col("censored"), block))
    n = F.floor(F.col("span_s") / F.col("block_s")) + 1
    gate = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("censored"), "censored_lag").when(n < least_blocks, "too_few_blocks").otherwise("pass")
    return rows.withColumns({"n_blocks": n, "gate": gate}).drop("span_s")
