"""A quality classifier on random-indexing word vectors.

Every token has a sparse random index vector; the word vector of a token is the sum of the index vectors of its
neighbours over the whole corpus, scaled to length one, plus its own index vector. Tokens are hashed into a fixed
number of buckets, so the table of word vectors has the same size whatever the corpus. A document is the mean, spread
and neighbours' likeness of its tokens' vectors, a two-layer network in numpy scores it, and a temperature fitted on training rows that
the network hasn't seen calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.spark_util import parts_by_bytes
from echofold.llm.words import SPACE, mix64, powers

BUCKETS, DIMS, NONZERO, REACH = 4096, 32, 4, 2
#: At most so many labelled rows train the network; those with the least hash of their id, over all rows.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS = 32, 40
FEATURES = 2 * DIMS + REACH + 1
_CHUNKS = 16
_GROUP = 1 << 20

_KIND = np.full(256, 3, np.uint8)
_KIND[SPACE] = 0
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[128:] = 1
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = powers(1 << 12)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's nonzero entries."""
    random = np.random.default_rng(11)
    places = np.argsort(random.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), random.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens (runs of letters, runs of digits, other marks one by one) and where each begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    starts = np.flatnonzero(new)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int(place.max()) + 1
    table = _POWERS if longest <= len(_POWERS) else powers(longest)
    hashes = mix64(np.add.reduceat(_BYTE[data] * table[place], starts))
    kept = kind[starts] > 0
    return (hashes[kept] >> np.uint64(20)).astype(np.int64) % BUCKETS, starts[kept]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, tokens' buckets, and the bounds of each text's tokens, about a MB of text at a time."""
    for batch in batches:
        for some in parts_by_bytes(batch, 1, _GROUP):
            part = [x or b"" for x in some.column(1).cast(pa.large_binary()).to_pylist()]
            found, starts = tokens(np.frombuffer(b"\n".join(part), np.uint8))
            yield some.column(0), found, np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in part]))


def context_sums(found: np.ndarray, bounds: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """BUCKETS x DIMS sums of neighbours' index vectors within the texts given."""
    places, signs = index
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = np.zeros(BUCKETS * DIMS)
    for reach in range(1, REACH + 1):
        near = text[reach:] == text[:-reach]
        left, right = found[:-reach][near], found[reach:][near]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * DIMS + places[b, k], weights=signs[b, k], minlength=BUCKETS * DIMS)
    return total.reshape(BUCKETS, DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, from all texts; it has a fixed size and is all that reaches the driver."""
    index = index_vectors()
    each = BUCKETS // _CHUNKS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMS))
        for _, found, bounds in _groups(batches):
            total += context_sums(found, bounds, index)
        sums = [total[k * each : (k + 1) * each].astype(np.int64).tobytes() for k in range(_CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(sums, pa.binary())], ["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(sums, np.int64)
                totals[chunk] = totals[chunk] + values if chunk in totals else values
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["chunk", "sums"])

    schema = "chunk int, sums binary"
    rows = docs.select(F.lit(0).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(gather, schema).repartition(_CHUNKS, "chunk").mapInArrow(add, schema).collect()
    total = np.zeros((BUCKETS, DIMS))
    for row in rows:
        total[row["chunk"] * each : (row["chunk"] + 1) * each] += np.frombuffer(row["sums"], np.int64).reshape(each, DIMS)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    np.put_along_axis(own := np.zeros((BUCKETS, DIMS)), index[0], index[1] / np.sqrt(NONZERO), axis=1)
    return (total + own).astype(np.float32)


def pool(found: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each text's token vectors pooled; zeros without tokens.

    Mean and standard deviation, the mean cosine of tokens one and two apart, and the logarithm of their number.
    """
    out = np.zeros((len(bounds) - 1, FEATURES))
    n = np.diff(bounds)
    full = np.flatnonzero(n > 0)
    if len(full):
        text = np.repeat(np.arange(len(n)), n)
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        for reach in range(1, REACH + 1):
            near = np.flatnonzero(text[reach:] == text[:-reach])
            cosine = np.einsum("ij,ij->i", unit[found[near]], unit[found[near + reach]])
            sums = np.bincount(text[near], weights=cosine, minlength=len(n))
            out[:, 2 * DIMS + reach - 1] = sums / np.maximum(n - reach, 1)
        out[:, -1] = np.log1p(n)
        rows = vectors[found].astype(np.float64)
        mean = np.add.reduceat(rows, bounds[full], axis=0) / n[full, None]
        square = np.add.reduceat(rows * rows, bounds[full], axis=0) / n[full, None]
        out[full, :DIMS], out[full, DIMS : 2 * DIMS] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    shift: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.maximum((x - self.shift) / self.scale @ w + b, 0) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Fit by Adam on four fifths of the rows and the temperature on the rest; without rows, scores are 0.5."""
    random = np.random.default_rng(seed)
    if not len(x):
        return Network(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)])
    order = random.permutation(len(x))
    rest, main = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(
        x[main].mean(axis=0),
        x[main].std(axis=0) + 1e-6,
        [random.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)],
    )
    z, moments, step = (x - net.shift) / net.scale, [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights], 0
    for epoch in range(EPOCHS):
        shuffled = random.permutation(main)
        for at in range(0, len(shuffled), 128):
            some = shuffled[at : at + 128]
            w, b, v, c = net.weights
            hidden = np.maximum(z[some] @ w + b, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ v + c[0], -40, 40))) - y[some]) / len(some)
            back = np.outer(error, v) * (hidden > 0)
            step += 1
            for k, g in enumerate((z[some].T @ back + 1e-4 * w, back.sum(axis=0), hidden.T @ error + 1e-4 * v, np.array([error.sum()]))):
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                rate = 0.004 * (1 - epoch / EPOCHS)
                net.weights[k] = net.weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    if len(rest):
        logits, truth = net.logits(x[rest]), y[rest]

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))

        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def is_held_out(doc_id):
    """The contract's fold: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _features(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, bounds in _groups(batches):
            pooled = pool(found, bounds, vectors)
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in pooled], pa.binary())], ["doc_id", "features"])

    return rows.mapInArrow(features, "doc_id string, features binary")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` and a network from labelled rows outside the held-out fold."""
    vectors = word_vectors(docs)
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("string").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(train_rows)
    )
    # At most train_rows rows of two numbers are broadcast, and as many feature vectors come back.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id")
    quality = chosen.select("doc_id", "quality").collect()
    known = {r["doc_id"]: r["quality"] for r in quality}
    rows = sorted({(r["doc_id"], bytes(r["features"])) for r in _features(picked.select("doc_id", "text"), vectors).collect()})
    x = np.array([np.frombuffer(f, np.float64) for _, f in rows]).reshape(len(rows), FEATURES)
    return vectors, train(x, np.array([known[i] for i, _ in rows], dtype=float))


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1) added as column ``name``, any other columns kept; a column that has this name is replaced."""
    docs = docs.drop(name)
    fields = docs.schema.fields
    at = [f.name for f in fields].index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, at):
                pair = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(at)], ["row", "text"])
                found = [net.scores(pool(t, b, vectors)) for _, t, b in _groups([pair])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*part.schema.names, name])

    return docs.mapInArrow(score, T.StructType(list(fields)).add(name, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) for documents (doc_id, text).

    Learns from ``labels`` (doc_id, quality) outside the held-out fold; rows with a null label or id teach nothing, and
    labels that disagree are averaged. A null or empty text has no tokens and gets the network's score for that.
    Rows that repeat are scored alike, one result each. Without labels all scores are 0.5; an empty table gives an
    empty result. Other columns are ignored.
    """
    vectors, net = fit(docs, labels, train_rows)
    rows = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    out = score_quality(rows, vectors, net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_random_indexing_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
