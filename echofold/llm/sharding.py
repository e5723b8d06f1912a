"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a ``hub`` (by default: the same text) are linked through it, so a group of n
copies costs n links instead of n*n. Labels start from a hash and move, round by round, towards
the shard where most of a document's group already is. A quota for every pair of shards keeps the loads
even: as many may go from i to j as come back from j to i, plus a part of j's free room. Documents
without links have no preference; they fill what is left, which makes the row counts exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.spark_util import cut, global_rank, ordered, text_or_empty

#: Steps into which a quota's last, partly admitted bin is cut.
FRACTION = 10_000
#: Bins by hub hash among the proposals of equal gain; each stands or moves as one.
BINS = 512


def text_hub(column: str = "text"):
    """Equal texts get equal hubs; a null text is no text and differs from the empty one."""
    return F.when(F.col(column).isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(F.col(column).cast("string"), 256)))


def _propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """One round over rows (..., hub, label): the same rows with new labels."""
    cells = linked.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    best = cells.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "label").alias("tie"), "label")).alias("best"))
    wishes = (
        cells.join(best, "hub")
        .where(F.col("label") != F.col("best.label"))
        .select(
            "hub",
            "label",
            F.col("best.label").alias("to"),
            "n",
            F.floor(F.log2((F.col("best.n") - F.col("n") + 1).cast("double"))).cast("int").alias("gain"),
            F.pmod(F.xxhash64("hub"), F.lit(BINS)).cast("int").alias("bin"),
        )
    )
    # Everything from here to ``shares`` has at most shards**2 * gains * BINS rows, whatever the input.
    bins = wishes.groupBy("label", "to", "gain", "bin").agg(F.sum("n").alias("n"))
    flows = bins.groupBy("label", "to").agg(F.sum("n").alias("x"))
    back = flows.select(F.col("to").alias("label"), F.col("label").alias("to"), F.col("x").alias("x_back"))
    loads = cells.groupBy(F.col("label").alias("to")).agg(F.sum("n").alias("load"))
    asked = flows.groupBy("to").agg(F.sum("x").alias("x_all"))
    quotas = (
        flows.join(F.broadcast(back), ["label", "to"], "left")
        .join(F.broadcast(loads), "to", "left")
        .join(F.broadcast(asked), "to")
        .select(
            "label",
            "to",
            (
                F.least("x", F.coalesce("x_back", F.lit(0)))
                + F.floor(F.greatest(F.lit(0), F.lit(capacity) - F.coalesce("load", F.lit(0))) * F.col("x") / F.col("x_all"))
            ).alias("quota"),
        )
    )
    before = Window.partitionBy("label", "to").orderBy(F.desc("gain"), "bin").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        bins.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(F.broadcast(quotas), ["label", "to"])
        .select(
            "label",
            "to",
            "gain",
            "bin",
            F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("quota") - F.col("used")) / F.col("n"))) * FRACTION).alias("share"),
        )
        .where("share > 0")
    )
    moves = wishes.join(shares, ["label", "to", "gain", "bin"]).select("hub", "label", F.col("to").alias("move_to"), "share")
    return (
        linked.join(moves, ["hub", "label"], "left")
        .withColumn("label", F.when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FRACTION)) < F.col("share"), F.col("move_to")).otherwise(F.col("label")))
        .drop("move_to", "share")
    )


def _in_blocks(linked: DataFrame, groups: DataFrame, target: list[int]) -> DataFrame:
    """Rows (..., hub) with hub as (hub, block): a group larger than a shard is cut into blocks of a shard's size and a rest."""
    small, most = max(1, min(target)), max(target)
    # Fewer than shards groups are larger than a shard.
    hot, wide, found = groups.where(F.col("n") > most).orderBy(F.desc("n"), "hub").select("hub", "n").collect(), target.count(most) if most > small else 0, []
    for r in hot:
        blocks = min(wide, r["n"] // most)
        wide -= blocks
        found.append((r["hub"], blocks))
    one = F.struct("hub", F.lit(0).cast("long").alias("block"))
    if not found:
        return linked.withColumn("hub", one)
    kind = groups.schema["hub"].dataType.simpleString()
    wides = F.broadcast(linked.sparkSession.createDataFrame(found, f"hub {kind}, wide long"))
    ranked = cut(global_rank(linked.join(wides, "hub"), "hub", "doc_id"))
    first = ranked.groupBy("hub").agg(F.min("_rank").alias("_first"))
    at, of_wide = F.col("_rank") - F.col("_first"), F.col("wide") * most
    block = F.when(at < of_wide, F.floor(at / most)).otherwise(F.col("wide") + F.floor((at - of_wide) / small)).cast("long")
    cut_up = ranked.join(F.broadcast(first), "hub").withColumn("hub", F.struct("hub", block.alias("block"))).drop("_rank", "_first", "wide")
    return linked.join(wides, "hub", "left_anti").withColumn("hub", one).unionByName(cut_up)


def _settle(cells: DataFrame, target: list[int]) -> DataFrame | None:
    """(hub, to) of the groups that fit whole, from rows (hub, label, n); no shard gets more than its target."""
    groups = cut(
        cells.groupBy("hub")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("held"))
        .withColumn("size_class", F.floor(F.log2(F.lit(float(max(target))) / F.col("n")) / 3))
    )
    room, placed = list(target), None
    for size_class in sorted(r[0] for r in groups.select("size_class").distinct().collect()):
        left = groups.where(F.col("size_class") == size_class)
        while True:
            free = F.array(*[F.lit(r).cast("long") for r in room])
            fits = F.filter(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.element_at(free, s + 1) >= F.col("n"))
            wish = F.array_max(F.transform(fits, lambda s: F.struct(F.coalesce(F.try_element_at("held", s), F.lit(0)).alias("own"), F.xxhash64("hub", s).alias("tie"), s.alias("to"))))
            wishes = left.withColumn("wish", wish).where("wish is not null").select("hub", "n", "held", F.col("wish.to").alias("to"), (-F.col("n")).alias("by_n"), (-F.col("wish.own")).alias("by_own"))
            rows = ordered(wishes, "to", "by_n", "by_own", "hub")
            sums = rows.groupBy("_part", "to").agg(F.sum("n").alias("sum"))
            before = sums.select("_part", "to", F.coalesce(F.sum("sum").over(Window.partitionBy("to").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
            used = F.col("before") + F.sum("n").over(Window.partitionBy("_part", "to").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0))
            dealt = cut(rows.join(F.broadcast(before), ["_part", "to"]).select("hub", "n", "held", "to", (used <= F.element_at(free, F.col("to") + 1)).alias("in")))
            # One row a shard comes to the driver.
            counts = dealt.groupBy("to").agg(F.sum(F.when(F.col("in"), F.col("n")).otherwise(0)).alias("n"), F.count_if(~F.col("in")).alias("out")).collect()
            if not counts:
                break
            some = dealt.where("in").select("hub", "to")
            placed = some if placed is None else placed.unionByName(some)
            for r in counts:
                room[r["to"]] -= r["n"]
            if not sum(r["out"] for r in counts):
                break
            left = dealt.where("not in").drop("to", "in")
    return placed


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 3, hub=None) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into shards whose row counts differ by one at most.

    ``hub``: a column expression; rows with equal hubs are linked. Returns doc_id, size (UTF-8 bytes + 1),
    text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null under this law).

    A null text counts as no bytes, has the checksum of no bytes and is linked with other null texts
    only. Rows that repeat are rows of their own and are linked. A group larger than a shard is
    split over as few as hold it; another one only where no shard has room left for it when its turn comes.
    ``rounds`` is of the rounds by quotas; groups then settle until none fits. An empty table gives an empty result. Other columns are ignored.
    """
    text = text_or_empty()
    rows = cut(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            (text_hub() if hub is None else hub).alias("hub"),
        )
    )
    total = rows.count()
    sizes = cut(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = cut(rows.join(sizes.select("hub", F.lit(True).alias("linked")), "hub", "left"))
    target = [total // shards + (s < total % shards) for s in range(shards)]
    linked = marked.where("linked").drop("linked").withColumn("label", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    linked = cut(_in_blocks(linked, sizes, target)) if total else linked.withColumn("hub", F.struct("hub", F.lit(0).cast("long").alias("block")))
    for _ in range(rounds):
        linked = cut(_propagate(linked, shards, -(-total // shards)))
    placed = _settle(linked.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n")), target) if total else None
    if placed is not None:
        linked = linked.join(placed, "hub", "left").withColumn("label", F.coalesce("to", F.lit(shards))).drop("to")
    alone = marked.where("linked is null").drop("linked").withColumns({"label": F.lit(shards), "hub": F.struct("hub", F.lit(0).cast("long").alias("block"))})

    everything = cut(linked.select("doc_id", "size", "text_crc32", "hub", "label").unionByName(alone.select("doc_id", "size", "text_crc32", "hub", "label")))
    ranked = global_rank(everything, "label", "hub", "doc_id")
    # shards + 1 counts come to the driver.
    held = {r["label"]: r["n"] for r in everything.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, spilled, stay = [0], [0], []
    for s in range(shards):
        n = held.get(s, 0)
        stay.append(min(n, target[s]))
        start.append(start[-1] + n)
        spilled.append(spilled[-1] + max(0, n - target[s]))
    room = [0]
    for s in range(shards):
        room.append(room[-1] + target[s] - stay[s])

    def at(values: list[int], index):
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)

    local = F.col("_rank") - at(start, F.col("label"))
    # Those beyond a shard's target, then those without links, fill the room left, in this order.
    out = ranked.withColumn("local", local).withColumn("over", F.col("label").eqNullSafe(F.lit(shards)) | (F.col("local") >= at(target + [0], F.col("label"))))
    out = out.withColumn("fill", at(spilled, F.col("label")) + F.col("local") - at(target + [0], F.col("label")))
    filled = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        filled = F.when(F.col("fill") < room[s + 1], F.lit(s)).otherwise(filled)
    out = out.withColumn("shard", F.when(F.col("over"), filled).otherwise(F.col("label")).cast("int"))
    slot = F.when(F.col("over"), at(stay, F.col("shard")) + F.col("fill") - at(room, F.col("shard"))).otherwise(F.col("local"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_balanced_label_propagation(spark, sf_dir: str) -> DataFrame:
    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
