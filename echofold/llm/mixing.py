"""Mixing sources to target weights by blocks of words.

The words of each source, its documents in order of id, form one stream that is packed into blocks of
``BLOCK`` words. Every source has a target; a run of slots visits its blocks in the order of a
pseudorandom permutation, once or twice over, until the target is met to the word. Slots are dealt to
output shards by multinomial draws whose sums over the shards are the sources' slot counts, so that a shard's
composition is random while the whole meets its targets. Slots and blocks then meet in a join on the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.spark_util import cut, global_rank, ordered, text_keys, text_or_empty

BLOCK = 256
#: Slots in an output shard, on average.
SHARD_SLOTS = 4096
#: Fixed values of the contract: weights by rank of the source, share of all words, most visits.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
VISITS = 2
WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(size) at ``index``, one size and key per element.

    A Feistel network over the next even number of bits; values beyond the size are walked on until
    they fall inside, which keeps it one-to-one.
    """
    value, size, key = (np.array(x, dtype=np.uint64) for x in np.broadcast_arrays(index, size, key))
    half = np.array([(max(int(n) - 1, 1).bit_length() + 1) // 2 for n in size.tolist()], dtype=np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(value))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = value[todo] >> h, value[todo] & m
        for r in reversed(range(_ROUNDS)) if inverse else range(_ROUNDS):
            salt = np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)
            if inverse:
                left, right = right ^ (_mix(left + k + salt) & m), left
            else:
                left, right = right, left ^ (_mix(right + k + salt) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


def _key(rank: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    return _mix(np.asarray(rank, dtype=np.uint64) * np.uint64(VISITS + 1) + np.asarray(turn, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B9))


def source_targets(sizes: DataFrame, share: float = SHARE, visits: int = VISITS, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, rank, weight and target from rows (source, source_size).

    A target is the lesser of ``visits`` times the size and a level times the weight; the level is raised, a pass over the
    table at a time, until the targets sum to ``share`` of all sizes. Two sums come to the driver each time.
    """
    ranked = global_rank(sizes.withColumn("no_source", F.col("source").isNull()), "no_source", "source", name="rank").drop("no_source")
    ranked = cut(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    most = F.col("source_size") * float(visits)
    everything, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level = share * (everything or 0), 0.0
    while everything and weight:
        raised = level
        level = wanted / weight if level == 0.0 else level
        full = F.col("weight") * level > most
        capped, free = ranked.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        level = max(level, (wanted - capped) / free)
        if level == raised:
            break
    return ranked.withColumn("target", F.least(most, F.col("weight") * level))


def _plan_source(size: int, target: float, rank: int, block: int, visits: int, seed: int) -> tuple[int, int, int, int, int]:
    """blocks, whole passes, slots of the last pass, words of its last slot, slots in all."""
    if size == 0:
        return 0, 0, 0, 0, 0
    blocks, short = -(-size // block), (size - 1) % block + 1
    wanted = min(round(target), visits * size)
    passes, rest = divmod(wanted, size)
    if not rest:
        return blocks, passes, 0, 0, passes * blocks
    # The stream's last block may be short; where it comes in this pass changes how many slots are needed.
    at = int(permuted([blocks - 1], [blocks], _key([rank], [passes], seed), inverse=True)[0])
    if rest <= at * block:
        slots = -(-rest // block)
        last = rest - (slots - 1) * block
    elif rest <= at * block + short:
        slots, last = at + 1, rest - at * block
    else:
        beyond = rest - at * block - short
        slots = at + 1 + -(-beyond // block)
        last = beyond - (slots - at - 2) * block
    return blocks, passes, slots, last, passes * blocks + slots


def plan_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, visits: int = VISITS, seed: int = 17) -> DataFrame:
    """One row per slot: rank (of the source), shard, slot, turn (pass over the source), block, words (taken from it)."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, s, *_plan_source(s, t, r, block, visits, seed)) for r, s, t in zip(batch["rank"].tolist(), batch["source_size"].tolist(), batch["target"].tolist())]
            yield pd.DataFrame(rows, columns=["rank", "source_size", "blocks", "passes", "last_slots", "last_words", "slots"])

    plans = cut(
        targets.select("rank", "source_size", "target").mapInPandas(
            plan, "rank long, source_size long, blocks long, passes long, last_slots long, last_words long, slots long"
        )
    )
    total = plans.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                random = np.random.default_rng([seed, row.rank])
                left, first = int(row.slots), 0
                # A multinomial draw over the shards, some thousand at a time.
                for begin in range(0, shards, 4096):
                    n = min(4096, shards - begin)
                    part = random.binomial(left, n / (shards - begin)) if begin + n < shards else left
                    counts = random.multinomial(part, np.full(n, 1 / n))
                    firsts = first + np.concatenate([[0], np.cumsum(counts)[:-1]])
                    left, first = left - int(part), first + int(part)
                    kept = counts > 0
                    out = pd.DataFrame({"shard": np.arange(begin, begin + n)[kept], "first": firsts[kept], "n": counts[kept]})
                    for name in ("rank", "source_size", "blocks", "passes", "last_slots", "last_words"):
                        out[name] = getattr(row, name)
                    yield out

    drawn = plans.where("slots > 0").mapInPandas(
        draw, "shard long, first long, n long, rank long, source_size long, blocks long, passes long, last_slots long, last_words long"
    )
    # A source's counts, one row per shard, are dealt out before they become slots.
    slots = drawn.repartition("rank", "shard").withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn = b["slot"] // b["blocks"]
            inside = b["slot"] % b["blocks"]
            index = permuted(inside.to_numpy(), b["blocks"].to_numpy(), _key(b["rank"].to_numpy(), turn.to_numpy(), seed))
            words = np.minimum(block, b["source_size"].to_numpy() - index * block)
            ends = ((turn == b["passes"]) & (inside == b["last_slots"] - 1)).to_numpy()
            words = np.where(ends, b["last_words"].to_numpy(), words)
            yield pd.DataFrame({"rank": b["rank"], "shard": b["shard"], "slot": b["slot"], "turn": turn, "block": index, "words": words})

    return slots.mapInPandas(visit, "rank long, shard long, slot long, turn long, block long, words long")


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: int = 17, keep_spans: bool = False) -> DataFrame:
    """Mix documents (doc_id, text, source) to the targets of their sources.

    Returns one row per document: doc_id, size (words), source, source_size, target (its source's), taken (words that
    the mix takes, repeats counted) and, with ``keep_spans``, spans: the word ranges taken, as
    array<struct<turn, shard, slot, first, last>> with ``last`` exclusive, and two hashes of the text, ha and hb.

    A null or empty text has no words and gives none. Null is a source of its own, ranked last. Rows that
    repeat are documents of their own. No word is taken more than twice. An empty table gives an empty
    result. Other columns are ignored. The same rows give the same mix on every run.
    """
    text = text_or_empty()
    rows = cut(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            *[c.alias(k) for k, c in text_keys(F.encode(text, "UTF-8")).items()],
        )
    )
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    rows = rows.join(targets.drop("weight"), rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = ordered(rows, "rank", "doc_id", "ha", "hb")
    within = Window.partitionBy("_part", "rank")
    totals = placed.groupBy("_part", "rank").agg(F.sum("size").alias("part_size"))
    # A source has at most one row per partition here.
    before = Window.partitionBy("rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", "rank", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    placed = cut(
        placed.withColumn("inside", F.sum("size").over(within.orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(totals, ["_part", "rank"])
        .withColumn("start", F.col("part_start") + F.col("inside"))
        .drop("inside", "part_start")
    )
    pieces = placed.where("size > 0").select(
        "_part",
        "_local",
        "rank",
        "start",
        "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    slots = plan_slots(targets, block, seed=seed)
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    met = pieces.join(slots, ["rank", "block"]).withColumns({"first": first - F.col("start"), "last": last - F.col("start")}).where("last > first")
    found = [F.sum(F.col("last") - F.col("first")).alias("taken")]
    if keep_spans:
        # At most two spans for every block that a document touches.
        found.append(F.array_sort(F.collect_list(F.struct("turn", "first", "last", "shard", "slot"))).alias("spans"))
    taken = met.groupBy("_part", "_local").agg(*found)
    out = placed.join(taken, ["_part", "_local"], "left")
    columns = ["doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return out.select(*columns, *(["ha", "hb", "spans"] if keep_spans else []))


def op3_block_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
