"""Operators over ordered detections: gaps, sessions, brackets, sequence loss, guard-banded blocks.

All windows are partitioned by a key. Where the order spans the whole table, ``global_sessions`` works by time bins and
passes one row per bin, never rows of data, through a window without keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.scratch import written

_START = Window.unboundedPreceding


def over(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def ordinals(df: DataFrame, keys: list[str], *order: str, name: str = "ordinal") -> DataFrame:
    """0-based place of each row within its key."""
    return df.withColumn(name, F.row_number().over(over(keys, *order)) - 1)


def gaps(df: DataFrame, keys: list[str], t: str, *tie: str, name: str = "gap") -> DataFrame:
    """Time since the row before; null for the first."""
    return df.withColumn(name, F.col(t) - F.lag(t).over(over(keys, t, *tie)))


def sessions(df: DataFrame, keys: list[str], t: str, longest_gap: int, *tie: str, name: str = "session") -> DataFrame:
    """A new session starts where the gap is strictly longer; an equal gap stays."""
    with_gap = gaps(df, keys, t, *tie, name="_gap")
    starts = F.when(F.col("_gap") > longest_gap, 1).otherwise(0)
    return with_gap.withColumn(name, F.sum(starts).over(over(keys, t, *tie).rowsBetween(_START, 0))).drop("_gap")


def global_sessions(df: DataFrame, t: str, longest_gap: int, bin_width: int, *tie: str, name: str = "component") -> DataFrame:
    """Sessions over the whole table's time order, in parallel by time bin."""
    binned = df.withColumn("_bin", F.floor(F.col(t) / bin_width))
    edges = binned.groupBy("_bin").agg(F.max(t).alias("_last"))
    by_bin = Window.orderBy("_bin")
    edges = edges.select("_bin", F.lag("_last").over(by_bin).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy(t, *tie)
    gap = F.col(t) - F.coalesce(F.lag(t).over(inside), F.col("_before"))
    cuts = binned.join(edges, "_bin").withColumn("_cut", F.when(gap > longest_gap, 1).otherwise(0))
    sums = cuts.groupBy("_bin").agg(F.sum("_cut").alias("_cuts"))
    sums = sums.select("_bin", F.coalesce(F.sum("_cuts").over(by_bin.rowsBetween(_START, -1)), F.lit(0)).alias("_base"))
    return cuts.join(sums, "_bin").withColumn(name, F.col("_base") + F.sum("_cut").over(inside.rowsBetween(_START, 0))).drop("_bin", "_before", "_cut", "_base")


def brackets(df: DataFrame, keys: list[str], t: str, tie: str, value: str, anchored: Column, tolerance: float) -> DataFrame:
    """Value between the nearest anchored rows before and after, and why there is none.

    Adds before, after and bracket: anchored, pre_lock, after_last_anchor, disagrees or recovered.
    """
    known = F.when(anchored, F.col(value))
    order = over(keys, t, tie)
    out = df.withColumns(
        {
            "before": F.last(known, ignorenulls=True).over(order.rowsBetween(_START, -1)),
            "after": F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    verdict = F.when(anchored, "anchored").when(F.col("before").isNull(), "pre_lock").when(F.col("after").isNull(), "after_last_anchor")
    return out.withColumn("bracket", verdict.when(F.abs(F.col("before") - F.col("after")) > tolerance, "disagrees").otherwise("recovered"))


def sequence_gaps(df: DataFrame, keys: list[str], order: list[str], seq: str, name: str = "missing") -> DataFrame:
    """Numbers that were skipped since the largest so far; 0 for repeats and the first."""
    most = F.max(seq).over(over(keys, *order).rowsBetween(_START, -1))
    return df.withColumn(name, F.greatest(F.coalesce(F.col(seq) - most - 1, F.lit(0)), F.lit(0)))


def segments(df: DataFrame, keys: list[str], order: list[str], counters: list[str], name: str = "segment") -> DataFrame:
    """A new segment where any counter falls below its last known value (a restart)."""
    w = over(keys, *order)
    falls = [F.col(c) < F.last(c, ignorenulls=True).over(w.rowsBetween(_START, -1)) for c in counters]
    fell = F.coalesce(falls[0], F.lit(False))
    for f in falls[1:]:
        fell = fell | F.coalesce(f, F.lit(False))
    marked = df.withColumn("_fell", fell.cast("int"))
    return marked.withColumn(name, F.sum("_fell").over(w.rowsBetween(_START, 0))).drop("_fell")


def guard_blocks(df: DataFrame, keys: list[str], t: str, block: int, guard: int, least_rows: int) -> DataFrame:
    """Adds block and fate: kept, in_guard (close after a block's start) or small_block."""
    starts = df.groupBy(*keys).agg(F.min(t).alias("_start"))
    out = df.join(starts, keys).withColumn("block", F.floor((F.col(t) - F.col("_start")) / block))
    inside = (F.col(t) - F.col("_start") - F.col("block") * block) < guard
    out = out.withColumn("_in", (inside & (F.col("block") > 0)).cast("int"))
    held = out.groupBy(*keys, "block").agg(F.sum(1 - F.col("_in")).alias("_held"))
    out = out.join(held, [*keys, "block"])
    return out.withColumn("fate", F.when(F.col("_in") == 1, "in_guard").when(F.col("_held") < least_rows, "small_block").otherwise("kept")).drop("_start", "_in", "_held")


def hysteresis(df: DataFrame, keys: list[str], t: str, tie: str, level: str, opens: float, closes: float) -> DataFrame:
    """Adds open: true from a level of ``opens`` or more until one below ``closes``; between them the last state holds."""
    edge = F.when(F.col(level) >= opens, True).when(F.col(level) < closes, False)
    return df.withColumn("open", F.coalesce(F.last(edge, ignorenulls=True).over(over(keys, t, tie).rowsBetween(_START, 0)), F.lit(False)))


def bin_nodes(df: DataFrame, t: str, node: str, width: int) -> DataFrame:
    """Distinct (bin, node)."""
    return df.select(F.floor(F.col(t) / width).alias("bin"), F.col(node).alias("node")).distinct()


def coactivity(df: DataFrame, t: str, node: str, width: int) -> DataFrame:
    """How many bins saw how many distinct nodes."""
    return bin_nodes(df, t, node, width).groupBy("bin").agg(F.count(F.lit(1)).alias("n_nodes")).groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_bins"))


#: Rows of a block of nodes that are counted against another block's, and nodes of a block; the same where they have names.
PAIR_ROWS, PAIR_NODES, NAMED_NODES = 1 << 21, 1 << 16, 4096


def pair_cooccurrence(df: DataFrame, t: str, node: str, width: int, block: int = PAIR_NODES) -> DataFrame:
    """Bins that two nodes share.

    Nodes are dealt into blocks of about ``block`` (eight at least), and each pair of blocks counts its own pairs (``pair_counts``). What is shuffled are the bins' nodes, packed, once for each block, and no pair.
    """
    from echofold.operators.matching import pair_counts

    one = written(bin_nodes(df, t, node, width).where("bin is not null and node is not null"))
    kind = one.schema["node"].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return _named_cooccurrence(one, min(block, NAMED_NODES))
    counted = pair_counts(one.select("node", F.col("bin").alias("t")), 0, PAIR_ROWS, block)
    return counted.select(F.col("node_a").cast(kind).alias("node_a"), F.col("node_b").cast(kind).alias("node_b"), F.col("n").alias("n_bins"))


def _named_cooccurrence(one: DataFrame, block: int) -> DataFrame:
    """The same for nodes that aren't numbers: a task holds the counts of one pair of blocks, and the names of both."""
    kind = one.schema["node"].dataType.simpleString()
    blocks = max(8, -(-one.agg(F.count_distinct("node")).first()[0] // block))
    # A list is as long as a block has nodes at most.
    lists = one.groupBy("bin", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("k")).agg(F.collect_list("node").alias("nodes"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    cells = lists.select("bin", "k", "nodes", other).select(F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "bin", "k", "nodes")
    dealt = cells.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "bin", "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, table, names, last = None, None, None, None
        for batch in batches:
            nodes = batch.column("nodes")
            keys = zip(*(batch.column(c).to_pylist() for c in ("i", "j", "bin", "k")))
            for row, (i, j, at, k) in enumerate(keys):
                if (i, j) != cell:
                    yield from _counted(table, names, cell, kind)
                    cell, table, names, last = (i, j), np.zeros((64, 64), np.int64), ({}, {}), None
                index = names[k != i]
                these = np.array([index.setdefault(n, len(index)) for n in nodes[row].as_py()])
                grown = [max(size, 1 << (len(index) - 1).bit_length()) for size, index in zip(table.shape, names if i != j else (names[0], names[0]))]
                if tuple(grown) != table.shape:
                    table = np.pad(table, [(0, g - size) for g, size in zip(grown, table.shape)])
                if i == j:
                    table[np.ix_(these, these)] += 1
                elif k == i:
                    last = (at, these)
                elif last is not None and last[0] == at:
                    table[np.ix_(last[1], these)] += 1
        yield from _counted(table, names, cell, kind)

    return dealt.mapInArrow(count, f"node_a {kind}, node_b {kind}, n_bins long")


def _counted(table, names, cell, kind: str, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell that share a bin, some rows of the table at a time."""
    if cell is None:
        return
    left = np.array(list(names[0]), dtype=None if kind != "string" else object)
    right = left if cell[0] == cell[1] else np.array(list(names[1]), dtype=left.dtype)
    step = max(1, rows // max(len(right), 1))
    for low in range(0, len(left), step):
        part = table[low : min(low + step, len(left)), : len(right)]
        a, b = np.nonzero(part)
        n, x, y = part[a, b], left[a + low], right[b]
        if cell[0] == cell[1]:
            once = x < y
            n, x, y = n[once], x[once], y[once]
        swap = y < x
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y)), pa.array(n)], ["node_a", "node_b", "n_bins"])


def lag_products(df: DataFrame, keys: list[str], t: str, tie: str, value: str, lags: list[int]) -> DataFrame:
    """Autocorrelation of ``value`` within a key at row lags: key, lag, n_pairs, acf (about the key's mean)."""
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    w = over(keys, t, tie)
    led = centred.withColumns({f"_l{k}": F.lead("_c", k).over(w) for k in lags})
    wide = led.select(*keys, "_c", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("later")) for k in lags])).alias("_l"))
    power = F.sum(F.col("_c") * F.col("_c"))
    agg = wide.groupBy(*keys, F.col("_l.lag").alias("lag")).agg(F.count("_l.later").alias("n_pairs"), F.sum(F.col("_c") * F.col("_l.later")).alias("_s"), power.alias("_p"))
    return agg.withColumn("acf", F.when(F.col("_p") > 0, F.col("_s") / F.col("_p"))).drop("_s", "_p")
