"""Hard negatives by blocked products of matrices: anchors against all rows, in two passes.

Anchors are numbered and go out in groups of a bounded size, each broadcast once for a pass. A task multiplies every batch of its rows with the blocks of the
group and keeps, for each anchor, the best of all its batches; what the tasks keep is merged by a window over a few rows from each task. The first
pass gives each anchor's positives. They say between which scores negatives must lie, so they go out with the anchors for the second pass. Components are whole
numbers: where products and sums stay below 2^53 float64 is exact, and blocks beyond that are multiplied as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.spark_util import cut, global_rank

#: Bytes of anchor vectors that are broadcast at a time, and anchors and rows in a block of products.
GROUP_BYTES, BLOCKS = 32 << 20, (1024, 2048)
_EXACT, _LONG = 2.0**53, 2.0**63


@dataclass
class Anchors:
    """A group of anchors: number, id, label and vector of each, and the scores of each one's positives, best first, nulls as the least long."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positives: np.ndarray | None = None


_NONE = np.iinfo(np.int64).min


def whole_vectors(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of lists as rows of float64, with 0 for what a list is shorter than ``width``."""
    lists = column.cast(pa.list_(pa.float64())) if not pa.types.is_float64(column.type.value_type) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
    if len(flat) == len(lists) * width:
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held in float64, exact, as int64."""
    most = anchors.shape[1] * np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0)
    if most < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    if most < _LONG:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    raise ValueError("an inner product may not fit a 64-bit integer")


def first(keys: tuple[np.ndarray, ...], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` first of their keys, best score first and then smallest id."""
    order = np.lexsort((ids, -score, *keys[::-1]))
    at = np.arange(len(order))
    begins = np.ones(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        begins[1:] &= sorted_key[1:] == sorted_key[:-1]
    begins = ~begins
    begins[:1] = True
    return order[at - np.maximum.accumulate(np.where(begins, at, 0)) < k]


class _Best:
    """For a block of anchors: the best entries (anchor's place in the group, positive's place, score, id) of all rows so far."""

    def __init__(self, group: Anchors, low: int, high: int, k: int, least: np.ndarray | None):
        part = slice(low, high)
        self.low, self.k = low, k
        self.ids, self.labels, self.vectors = group.ids[part], group.labels[part], group.vectors[part]
        self.columns = [np.zeros(0, np.int64) for _ in range(4)]
        # The lowest score that is still of use, for each anchor or each positive of it, and the highest.
        self.limit = np.full((len(self.ids), 1), _NONE) if least is None else least[part].copy()
        self.tops = None if least is None else group.positives[part]

    def _keep(self, at: np.ndarray, turn: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        both = [np.concatenate(c) for c in zip(self.columns, (at, turn, score, ids))]
        kept = first((both[0], both[1]), both[2], both[3], self.k)
        self.columns = [c[kept] for c in both]
        key = self.columns[0] * self.limit.shape[1] + self.columns[1]
        ends = np.flatnonzero(np.diff(key, append=-1))
        full = ends[np.diff(ends, prepend=-1) == self.k]
        # A score below the last of k found can't be among the first k.
        self.limit.reshape(-1)[key[full]] = self.columns[2][full]

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        score = products(self.vectors, vectors)
        if self.tops is None:
            at, row = np.nonzero((labels == self.labels[:, None]) & (ids != self.ids[:, None]) & (score >= self.limit))
            self._keep(at, np.zeros_like(at), score[at, row], ids[row])
            return
        # Scores in the window of some positive are looked at one positive after the other.
        at, row = np.nonzero((labels != self.labels[:, None]) & (score <= self.tops.max(1)[:, None]) & (score >= self.limit.min(1)[:, None]))
        found = score[at, row]
        fits = [np.flatnonzero((found <= self.tops[at, j]) & (found >= self.limit[at, j])) for j in range(self.tops.shape[1])]
        which = np.concatenate(fits)
        self._keep(at[which], np.repeat(np.arange(len(fits)), [len(f) for f in fits]), found[which], ids[row[which]])

    def result(self) -> list[np.ndarray]:
        return [self.columns[0] + self.low, *self.columns[1:]]


def _lowest(positives: np.ndarray, window: tuple[int, int]) -> np.ndarray:
    """The smallest whole score s with window[0] * p <= window[1] * s, for each positive score p."""
    out = [-((-window[0] * int(p)) // window[1]) if p != _NONE else np.iinfo(np.int64).max for p in positives.reshape(-1)]
    return np.array(out, np.int64).reshape(positives.shape)


def hard_negatives(
    rows: DataFrame, is_anchor: str = "vec_id % 100 = 0", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 5, window: tuple[int, int] = (80, 100), group_bytes: int = GROUP_BYTES, blocks: tuple[int, int] = BLOCKS
) -> DataFrame:
    """Negatives for the positives of anchors among rows (vec_id, embedding, label).

    A row's score is the inner product of floor(scale * x) of its components with the anchor's. An anchor's positives are the first ``n_positives`` other
    rows of its label; for each, the first ``n_negatives`` rows of other labels with window[0] * positive_score <= window[1] * negative_score <=
    window[1] * positive_score are returned: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Best scores come
    first, ties by smaller vec_id.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. A row is another one than the anchor if its vec_id
    is. Rows that repeat count each: repeated anchors are answered each, a repeated row may be several positives or negatives. A shorter vector has zeros at its end; an empty
    one scores 0. Scores beyond a 64-bit integer are an error. An empty table, or one without anchors, gives an empty result. Other columns
    are ignored. The table is read twice for every ``group_bytes`` of anchors.
    """
    spark = rows.sparkSession
    good = rows.where("vec_id is not null and label is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    numbered = cut(global_rank(good.where(is_anchor), "vec_id", "label", name="number"))
    n, width = numbered.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    longest = good.agg(F.max(F.size("embedding"))).first()[0] if n else 0
    width = max(width or 0, longest or 0)
    step = max(1, group_bytes // (8 * max(1, width)))
    made = []
    for low in range(0, n, step):
        # At most ``step`` anchors, so group_bytes of vectors.
        table = numbered.where(F.col("number").between(low, low + step - 1)).orderBy("number").toArrow().combine_chunks()
        vectors = whole_vectors(table["embedding"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())), scale, width)
        group = Anchors(*(table[c].to_numpy() for c in ("number", "vec_id", "label")), vectors)
        found = _pass(spark, good, group, scale, width, n_positives, window, blocks)
        ranked = Window.partitionBy("at").orderBy(F.desc("score"), "id")
        positives = cut(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n_positives))
        # n_positives scores for each anchor of the group.
        scores = positives.select("at", "rank", "score").toArrow()
        group.positives = np.full((len(group.ids), n_positives), _NONE)
        group.positives[scores["at"].to_numpy(), scores["rank"].to_numpy() - 1] = scores["score"].to_numpy()
        found = _pass(spark, good, group, scale, width, n_negatives, window, blocks)
        ranked = Window.partitionBy("at", "turn").orderBy(F.desc("score"), "id")
        negatives = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n_negatives)
        both = negatives.alias("n").join(positives.alias("p"), (F.col("n.at") == F.col("p.at")) & (F.col("n.turn") == F.col("p.rank") - 1))
        ids = numbered.select(F.col("number"), F.col("vec_id").alias("anchor_id"))
        out = both.join(ids, F.col("number") == F.col("n.at") + F.lit(low))
        made.append(cut(out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))))
    if not made:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _pass(spark, good: DataFrame, group: Anchors, scale: float, width: int, k: int, window: tuple[int, int], blocks: tuple[int, int]) -> DataFrame:
    """What each task keeps: anchors' places in the group, the positive's (0 in the first pass), scores and ids of rows."""
    sent = spark.sparkContext.broadcast(group)
    names = ["at", "turn", "score", "id"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        least = None if mine.positives is None else _lowest(mine.positives, window)
        kept = [_Best(mine, low, low + blocks[0], k, least) for low in range(0, len(mine.ids), blocks[0])]
        for batch in batches:
            for at in range(0, batch.num_rows, blocks[1]):
                part = batch.slice(at, blocks[1])
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                vectors = whole_vectors(part.column(2), scale, width)
                for block in kept:
                    block.add(ids, labels, vectors)
        for block in kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in block.result()], names)

    return good.mapInArrow(multiply, ", ".join(f"{c} long" for c in names))


def op13_blocked_gemm_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))
