"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first one scatters the shingles, and the second, shifted
circularly by k, gives coordinate k as its least value over the set. Documents that agree on all rows of a
band meet in a bucket. Equal sets count once, as a class.

A bucket isn't expanded into all its pairs. Its members are first compared with one leader, which joins most of a group of
copies. In buckets where many are left outside the largest component, each then looks for its likest partner outside its own.
Comparisons are made on a byte of each coordinate, by blocks of members in numpy, and
only pairs whose signatures agree about as often as the limit asks are verified on the full sets (a pair at the limit
fails that with a chance of about 1 in a million, as it fails to meet in any band). A last round does so for everyone who has such a
partner left: it counts common shingles within the blocks and gives out nothing but verified links. So every pair that meets in a bucket is joined already,
ruled out by its signatures or verified, and the components are the same as with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.components import components
from echofold.llm.spark_util import cut, marked, parts_by_bytes, text_keys, text_or_empty
from echofold.llm.words import many_word_hashes, mix64, shingle_set

BANDS, ROWS = 28, 4
#: Members that one task compares at a time: of those that look for partners, and of those among which they look.
QUERIES, MEMBERS = 256, 2048
#: Shingles of the members that one task verifies at a time, on average.
SHINGLES = 1 << 20
#: Rounds, at most, in which each looks for its likest partner only, before the one that takes all partners. They are held in the buckets whose
#: members would meet more than MOST_BLOCKS blocks of askers, and change the work, never the result.
LIKEST_ROUNDS, MOST_BLOCKS = 3, 4
_STEP = np.uint32(0x9E3779B1)
_SHIFTS = (np.arange(BANDS * ROWS, dtype=np.uint32) * _STEP)[:, None]
_BAND_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_WIDTH = 1024


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least values of the second permutation, one for each circular shift."""
    scattered = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(scattered), _WIDTH):
        x = scattered[at : at + _WIDTH][None, :] + _SHIFTS
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        here = x.min(axis=1)
        least = here if least is None else np.minimum(least, here)
    return least


def band_keys(sign: np.ndarray) -> np.ndarray:
    total = _BAND_SALT.copy()
    for column in sign.reshape(BANDS, ROWS).T.astype(np.uint64):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, ha, hb, n_shingles, two hashes of the set as a whole, its band keys, and a byte of each coordinate with two of each band key (null without shingles)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, 3):
                n, one, two, bands, signs = [], [], [], [], []
                for hashes in many_word_hashes(part.column(3).to_pylist(), lower=True):
                    s = shingle_set(hashes, words)
                    sign = signature(s) if len(s) else None
                    n.append(len(s))
                    one.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    two.append(int(np.bitwise_xor.reduce(mix64(s * np.uint64(3))).view(np.int64)) if len(s) else 0)
                    bands.append(band_keys(sign) if len(s) else None)
                    signs.append(sign.astype(np.uint8).tobytes() + bands[-1].astype(np.uint16).tobytes() if len(s) else None)
                arrays = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], ["doc_id", "ha", "hb", "n_shingles", "set_a", "set_b", "bands", "sign"])

    schema = T.StructType([rows.schema["doc_id"]])
    for name in ("ha", "hb", "n_shingles", "set_a", "set_b"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(sketch, schema.add("bands", T.ArrayType(T.LongType())).add("sign", "binary"))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """member, shingles for rows (member, bytes)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, 1, 1 << 20):
                sets = [shingle_set(h, words).view(np.int64) for h in many_word_hashes(part.column(1).to_pylist(), lower=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["member", "shingles"])

    return rows.mapInArrow(gather, "member long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("member").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("member").alias("b"), F.col("shingles").alias("t"))
    full = pairs.join(left, "a").join(right, "b")
    # A cheap bound first: the intersection is at most the smaller set, the union at least the larger.
    full = full.where(100 * F.least(F.size("s"), F.size("t")) >= percent * F.greatest(F.size("s"), F.size("t")))
    common = F.size(F.array_intersect("s", "t"))
    return full.where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("a", "b")


def _least_agreement(percent: int) -> int:
    """Coordinates in which pairs at the limit agree, but for a chance of about one in a million."""
    n, p = BANDS * ROWS, percent / 100
    return int(n * p - 4.75 * (n * p * (1 - p)) ** 0.5)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from rows that come sorted by ``cell``, their first column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        cell = table.column(0).to_numpy()
        # The last cell may go on in the next batch.
        last = int(np.searchsorted(cell, cell[-1]))
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _askers(table: pa.Table, percent: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Begin and end of the cell, an asker, and the rows it is to be compared with: other components, and sizes that may do."""
    cell, asks, component, size = (table.column(k).to_numpy() for k in ("cell", "asks", "component", "n_shingles"))
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    for begin, end in zip(edge.tolist(), np.append(edge[1:], len(cell)).tolist()):
        group = np.arange(begin, end)
        among = group[asks[begin:end] != 1]
        for q in group[asks[begin:end] > 0]:
            near = among[(component[among] != component[q]) & (100 * np.minimum(size[among], size[q]) >= percent * np.maximum(size[among], size[q]))]
            if len(near):
                yield begin, end, q, near


def _ordered_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(left or none), np.concatenate(right or none)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch], percent: int, likest: bool, members_only: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures may do, of each asker only the likest if asked; or (bucket, member) for all who are in one."""
    least = _least_agreement(percent)
    for table in _by_cell(batches):
        member = table.column("member").to_numpy()
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(len(member), -1)
        band = table.column("band").to_numpy()
        left, right, buckets = [], [], []
        for _, _, q, near in _askers(table, percent):
            equal = sign[near] == sign[q]
            agree = equal[:, : BANDS * ROWS].sum(axis=1)
            if members_only:
                # Who meets in an earlier band, too, is compared there.
                earlier = equal[:, : band[q] * ROWS].reshape(len(near), -1, ROWS).all(axis=2) & equal[:, BANDS * ROWS : BANDS * ROWS + 2 * band[q]].reshape(len(near), -1, 2).all(axis=2)
                near, agree = near[~earlier.any(axis=1)], agree[~earlier.any(axis=1)]
            if likest:
                near, agree = near[[agree.argmax()]], agree[[agree.argmax()]]
            near = near[agree >= least]
            if members_only:
                buckets += [near, [q]] if len(near) else []
            left.append(np.repeat(member[q], len(near)))
            right.append(member[near])
        if members_only:
            rows = np.unique(np.concatenate(buckets)) if buckets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[rows], pa.int64()) for c in ("bucket", "member")], ["bucket", "member"])
        else:
            yield _ordered_pairs(left, right)


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose full sets do."""
    for table in _by_cell(batches):
        member, size = table.column("member").to_numpy(), table.column("n_shingles").to_numpy()
        sets = table.column("shingles").combine_chunks()
        stops = sets.offsets.to_numpy()
        left, right, now, ids, flags = [], [], -1, np.zeros(0, np.int64), np.zeros(0, bool)
        for begin, end, q, near in _askers(table, percent):
            if begin != now:
                now, base = begin, stops[begin]
                values, ids = np.unique(sets.values.to_numpy()[base : stops[end]], return_inverse=True)
                flags = np.zeros(len(values), bool)
            own = ids[stops[q] - base : stops[q + 1] - base]
            flags[own] = True
            # No set is empty, so each row's count is a sum over a stretch of its own.
            common = np.add.reduceat(flags[ids], stops[begin:end] - base, dtype=np.int64)[near - begin]
            flags[own] = False
            near = near[100 * common >= percent * (size[near] + size[q] - common)]
            left.append(np.repeat(member[q], len(near)))
            right.append(member[near])
        yield _ordered_pairs(left, right)


def _cells(seen: DataFrame, slices, *columns: str) -> DataFrame:
    """Rows (cell, asks, member, ...) sorted by cell: a bucket's askers are cut into blocks and its members into slices.

    asks: 0 for members among whom askers look, 1 for askers, 2 for both at once where the bucket is a single cell.
    """
    row = ["bucket", "member", "component", "n_shingles", *columns]
    blocks, slices = F.ceil(F.col("n_asks") / QUERIES).cast("int"), F.ceil(slices).cast("int")
    cut_up = seen.withColumns({"blocks": blocks, "slices": slices}).withColumn("one", (F.col("blocks") == 1) & (F.col("slices") == 1))
    block, part = F.pmod(F.xxhash64("member", F.lit(1)), "blocks").cast("int"), F.pmod(F.xxhash64("member", F.lit(2)), "slices").cast("int")
    among = cut_up.where("not one or not asks").select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(0).alias("asks"), *row)
    ask = cut_up.where("asks").select(
        block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), F.when(F.col("one"), 2).otherwise(1).alias("asks"), *row
    )
    cells = ask.unionByName(among).select(F.xxhash64("bucket", "block", "part").alias("cell"), "asks", *row)
    return cells.repartition("cell").sortWithinPartitions("cell", F.desc("asks"), "member")


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Component labels (node, component) of everything linked within buckets (bucket, member, n_shingles, sign, band); None without links."""
    links, labels, turn = None, None, 0
    while True:
        if turn == 0:
            heads = members.groupBy("bucket").agg(F.min("member").alias("leader"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("n_asks"))
            seen = members.join(heads, "bucket").withColumns({"component": F.col("member"), "asks": F.col("member") == F.col("leader")}).drop("leader")
        else:
            known = members if labels is None else members.join(labels.select(F.col("node").alias("member"), "component"), "member", "left")
            known = known.withColumn("component", F.coalesce("component", "member") if labels is not None else F.col("member"))
            parts = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("size"))
            heads = parts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), (F.sum("size") / F.sum("k")).alias("mean_size"))
            heads = heads.where("parts > 1").select("bucket", "n", "mean_size", (F.col("n") - F.col("main.k")).alias("n_asks"), F.col("main.component").alias("main"))
            seen = known.join(heads, "bucket").withColumn("asks", F.col("component") != F.col("main")).drop("main")
        last = False
        if turn:
            seen = cut(seen)
            crowded = seen.where(F.col("n_asks") > MOST_BLOCKS * QUERIES)
            last = turn > LIKEST_ROUNDS or not crowded.limit(1).count()
            seen = seen if last else crowded
        by_count = _cells(seen, F.col("n") / MEMBERS, "sign", "band")
        if not last:
            pairs = by_count.mapInArrow(lambda batches: _alike(batches, percent, turn > 0, False), "a long, b long").distinct()
            found = _verified(pairs, sets, percent)
        else:
            left = cut(by_count.mapInArrow(lambda batches: _alike(batches, percent, False, True), "bucket long, member long").distinct())
            rest = seen.drop("sign", "band").join(left, ["bucket", "member"], "left_semi").join(sets, "member")
            found = _cells(rest, F.col("n") * F.col("mean_size") / SHINGLES, "shingles").mapInArrow(lambda batches: _linked(batches, percent), "a long, b long").distinct()
        found = cut(found)
        any_found = bool(found.limit(1).count())
        if any_found:
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        if last:
            return labels
        # Without new links a further look for the likest partners is in vain.
        turn = turn + 1 if any_found else LIKEST_ROUNDS + 1


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, ha, hb (hashes of the text), n_shingles and group for every row of documents (doc_id, text); without shingles the group is null.

    A group is a component under 100 * intersection >= percent * union of word shingles; its number has no meaning.
    """
    data = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select("doc_id", *[c.alias(k) for k, c in text_keys(data).items()], data.alias("bytes"))
    sketches = cut(_sketches(rows, words))
    classes = sketches.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("ha", "hb")).alias("text"), F.any_value("bands").alias("bands"), F.any_value("sign").alias("sign"))
    # The number of a class is written down with it, so it stays.
    classes = cut(classes.withColumn("member", F.monotonically_increasing_id()))
    entries = classes.select("member", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = entries.join(shared, "bucket", "left_semi").join(classes.select("member", "n_shingles", "sign"), "member")
    members = cut(members)
    candidates = cut(classes.join(members.select("member").distinct(), "member", "left_semi").select("text.*", "member"))
    likely = marked(rows.drop("doc_id"), candidates, ["ha", "hb"]).where("_maybe").drop("_maybe")
    texts = likely.dropDuplicates(["ha", "hb"]).join(candidates, ["ha", "hb"]).select("member", "bytes")
    # Kept by member on the executors' disks, so that no round shuffles them; what is lost is computed again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _sets(texts, words).repartition(parts, "member").persist(StorageLevel.DISK_ONLY)
    labels = _links(members, sets, percent)
    sets.unpersist()
    names = classes.select("n_shingles", "set_a", "set_b", "member")
    if labels is not None:
        names = names.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("group", F.coalesce("component", "member")).drop("component")
    else:
        names = names.withColumn("group", F.col("member"))
    return sketches.drop("bands", "sign").join(names.drop("member"), ["n_shingles", "set_a", "set_b"], "left").select("doc_id", "ha", "hb", "n_shingles", "group")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents (doc_id, text) under 100 * intersection >= percent * union of word shingles.

    Returns doc_id, n_shingles (distinct shingles), component_id (smallest doc_id reachable) and kept (doc_id =
    component_id). A-Z is lower-cased; a text with fewer words than a shingle has is one shingle.

    A document without words or with a null text has no shingles and is its own component. Rows that repeat stay
    and are linked. Unlike texts with one doc_id are linked only where they are near; ``doc_id`` may be of any type that can be ordered. A null
    doc_id is linked, but names a component only where no other does. Ties go to the smallest id. An empty table gives an
    empty result. Other columns are ignored.
    """
    found = cut(near_groups(docs, words, percent))
    least = found.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = found.join(least, "group", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def op4_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
