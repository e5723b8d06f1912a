"""Removal of byte strings of 200 and more that occur more than once in the corpus.

Equal texts count as one from the start: where such a text has copies, all its windows of 200 bytes occur elsewhere.
Every window belongs to one anchor: the 40 bytes in it with the least hash, leftmost among equals. Equal windows have
equal anchors, so windows are compared only where an anchor occurs more than once. An anchor's windows form a stretch of text.
Stretches that are equal as a whole settle each other by their count, within a document at once. The distinct ones of an anchor form
a cell, and a run-length index tells which of their windows occur in others: the Burrows-Wheeler transform of the stretches is cut
into runs of equal bytes, text positions are kept for both ends of each run only, common prefixes are measured only there, and a
pass along the text gives the matching statistics of all other positions, one less at each step.

An index holds some hundred KB, so that its memory is bounded. A cell with more than that is divided exactly: a window whose anchor
stands in its second half (by offset) also holds the bytes before the anchor, any other one the bytes behind it, and a hash of the bytes that are
certain names the new cell. Halving goes on as far as needed, at last down to single windows, where a cell is one distinct string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.spark_util import cut, marked, parts_by_bytes, scratch_table, text_keys, text_or_empty
from echofold.llm.suffixes import suffix_order
from echofold.llm.words import mix64

LENGTH, GRAM = 200, 40
#: Bytes of distinct stretches that one index takes; cells above it are divided.
INDEX_BYTES = 256 << 10
_SEGMENT = 1 << 18
_BYTE = np.random.default_rng(200).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position, by composing hashes of powers of two."""
    parts, h, m = {}, _BYTE[data], 1
    while True:
        parts[m] = h
        if 2 * m > size:
            break
        h = h[:-m] * np.uint64(pow(_BASE, m, 2**64)) + h[m:]
        m *= 2
    n, at, total = len(data) - size + 1, 0, None
    for m in sorted(parts, reverse=True):
        if at + m <= size:
            here = parts[m][at : at + n]
            total = here.copy() if total is None else total * np.uint64(pow(_BASE, m, 2**64)) + here
            at += m
    return mix64(total)


def stretches(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the stretch, first and last window start, and the anchor's place, for the anchors of a text."""
    span = LENGTH - GRAM + 1
    anchors, firsts, lasts, places = [], [], [], []
    for begin in range(0, max(len(text) - LENGTH + 1, 0), _SEGMENT):
        data = np.frombuffer(text, np.uint8)[begin : begin + _SEGMENT + LENGTH - 1]
        grams = gram_hashes(data, GRAM)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        anchors.append(grams[at[first]])
        firsts.append(first + begin)
        lasts.append(np.append(first[1:], len(at)) - 1 + begin)
        places.append(at[first] + begin)
    if not anchors:
        return (np.zeros(0, np.int64),) * 5
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    return np.concatenate(anchors).view(np.int64), _digests(text, first, last), first, last, np.concatenate(places)


def _digests(text: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(text[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())], dtype=np.uint64).view(np.int64)


def matching_statistics(texts: list[bytes]) -> np.ndarray:
    """For each position of the texts, laid end to end: bytes of the longest string from there that starts elsewhere, too."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    stops = np.cumsum(sizes)
    end, begin = np.repeat(stops, sizes), np.repeat(stops - sizes, sizes)
    here = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        moved = np.minimum(here + k, n - 1)
        key = (key << 9) | np.where(here + k < end, data[moved], 0)
    order, levels = suffix_order(key, end, 7)
    # The transform; what stands before a text's start equals nothing. Runs are all that is kept of it.
    before = np.where(order > begin[order], data[order - 1], 0)
    new_run = np.ones(n, bool)
    new_run[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    heads = np.flatnonzero(new_run)
    tails = np.append(heads[1:], n) - 1
    head_at, tail_at = order[heads], order[tails]
    above = np.where(heads > 0, order[heads - 1], -1)
    below = np.where(tails < n - 1, order[np.minimum(tails + 1, n - 1)], -1)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of suffixes a and b; 0 where b is -1."""
        out = np.zeros(len(a), np.int64)
        most = np.where(b >= 0, np.minimum(end[a] - a, end[b] - b), 0)
        for k in reversed(range(len(levels))):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((out < most) & (levels[k][x] == levels[k][y]), 7 << k, 0)
        for _ in range(6):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (out < most) & (data[x] == data[y])
        return np.minimum(out, most)

    best = np.zeros(n, np.int64)
    for at, other in ((head_at, above), (tail_at, below)):
        # Between samples the value falls by one a step; every text's first position is a sample.
        sampled = np.full(n, -1, np.int64)
        sampled[at] = common(at, other)
        last = np.maximum.accumulate(np.where(sampled >= 0, here, -1))
        best = np.maximum(best, sampled[last] - (here - last))
    return best


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edge[::2], edge[1::2] - 1


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by their first, with those that touch joined."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    new = np.append(True, first[1:] > reach[:-1] + 1)
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def _named(docs: DataFrame, *others: str) -> DataFrame:
    """ha, hb, the text in UTF-8 as ``bytes``, and further columns as one struct ``rest``."""
    data = F.encode(text_or_empty(), "UTF-8")
    return docs.select(*[c.alias(k) for k, c in text_keys(data).items()], data.alias("bytes"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest") if others else F.lit(None).cast("int").alias("rest"))


def _distinct_texts(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """ha, hb, bytes: each text once. Only texts that may have copies (``copied``: ha, hb) are shuffled."""
    rows = marked(_named(docs).drop("rest"), copied, ["ha", "hb"])
    return rows.where("not _maybe").drop("_maybe").unionByName(rows.where("_maybe").drop("_maybe").dropDuplicates(["ha", "hb"]))


_FOUND = ["ha", "hb", "anchor", "whole", "first", "last", "place"]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text, equal ones of a text once; ranges of windows that occur twice within a text have a null anchor."""
    for batch in batches:
        for part in parts_by_bytes(batch, 2):
            out, local = [[] for _ in _FOUND], []
            for ha, hb, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                anchor, whole, first, last, place = stretches(text)
                _, once, kind, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero(n[kind] > 1)
                a, b = _merged(first[again], last[again])
                once.sort()
                both = [np.concatenate([x[once], y]) for x, y in ((anchor, 0 * a), (whole, 0 * a), (first, a), (last, b), (place, a))]
                for column, values in zip(out, [np.full(len(both[0]), ha), np.full(len(both[0]), hb), *both]):
                    column.append(values)
                local.append(np.arange(len(once) + len(a)) >= len(once))
            none = np.concatenate(local) if local else np.zeros(0, bool)
            values = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            arrays = [pa.array(v, pa.int64() if name in ("ha", "hb", "anchor", "whole") else pa.int32(), mask=none if name in ("anchor", "whole") else None) for name, v in zip(_FOUND, values)]
            yield pa.RecordBatch.from_arrays(arrays, _FOUND)


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (ha, hb, cell, whole, first, last, place) with the bytes of each stretch."""
    keys = wanted.select("ha", "hb").distinct()
    likely = marked(texts, keys, ["ha", "hb"]).where("_maybe").drop("_maybe")
    # As many entries as the text has stretches.
    listed = wanted.groupBy("ha", "hb").agg(F.collect_list(F.struct("cell", "whole", "first", "last", "place")).alias("wanted"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, 2):
                wants = part.column(3)
                n = np.diff(wants.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), n)
                fields = {k: v for k, v in zip(("cell", "whole", "first", "last", "place"), wants.flatten().flatten())}
                texts, first, last = part.column(2).to_pylist(), fields["first"].to_pylist(), fields["last"].to_pylist()
                for at in range(0, len(row), 8192):
                    here = slice(at, at + 8192)
                    data = [texts[i][a : b + LENGTH] for i, a, b in zip(row[here].tolist(), first[here], last[here])]
                    own = pa.array(row[here])
                    columns = [part.column(0).take(own), part.column(1).take(own), *(fields[k].slice(at, 8192) for k in ("cell", "whole", "first", "place")), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["ha", "hb", "cell", "whole", "first", "place", "stretch"])

    schema = "ha long, hb long, cell long, whole long, first int, place int, stretch binary"
    return likely.join(listed, ["ha", "hb"]).select("ha", "hb", "bytes", "wanted").mapInArrow(take, schema)


def _halves(level: int):
    """A pass over stretches of cells that are too large: both halves by the anchor's offset, with the hashes that name cell and stretch."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in parts_by_bytes(batch, 8):
                rows = []
                for ha, hb, cell, _, first, place, low, high, data in zip(*(c.to_pylist() for c in part.columns)):
                    middle = (low + high) // 2
                    for a, b in ((low, middle), (middle, high)):
                        # Windows whose anchor is a .. b - 1 bytes behind their start all hold the bytes from place - a to place - b + 201.
                        begin, end = max(first, place - b + 1), min(first + len(data) - LENGTH, place - a)
                        if a == b or begin > end:
                            continue
                        sure = data[place - a - first : place - b + 1 + LENGTH - first]
                        some = data[begin - first : end + LENGTH - first]
                        name = digest(sure, seed=level * 1000 + a) ^ (cell & 0xFFFFFFFFFFFFFFFF)
                        rows.append((ha, hb, name - (1 << 64) if name >> 63 else name, digest(some) - 2**63, begin, place, a, b, some))
                kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], part.schema.names)

    return divide


def _by_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that occur in another stretch of their cell, from rows that come sorted by cell, a few cells per index."""

    def indexed(rows: list[tuple]) -> pa.RecordBatch:
        found = matching_statistics([r[4] for r in rows]) >= LENGTH
        keys, firsts, lasts, at = [], [], [], 0
        for ha, hb, _, first, data in rows:
            a, b = _ranges(found[at : at + len(data) - LENGTH + 1])
            keys += [(ha, hb)] * len(a)
            firsts += (a + first).tolist()
            lasts += (b + first).tolist()
            at += len(data)
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["ha", "hb", "first", "last"])

    held, size, cell = [], 0, None
    for batch in batches:
        for part in parts_by_bytes(batch, 4):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[2] != cell and size >= INDEX_BYTES:
                    yield indexed(held)
                    held, size = [], 0
                held.append(row)
                size, cell = size + len(row[4]), row[2]
    if held:
        yield indexed(held)


_SPLIT = "ha long, hb long, cell long, whole long, first int, place int, low int, high int, stretch binary"


def _indexed(stretches: DataFrame) -> DataFrame:
    """Windows (ha, hb, first, last) of distinct stretches (ha, hb, cell, whole, first, place, stretch) that others of their cell hold, too."""
    rows, found, level = stretches.withColumns({"low": F.lit(0), "high": F.lit(LENGTH - GRAM + 1)}).select("ha", "hb", "cell", "whole", "first", "place", "low", "high", "stretch"), None, 0

    def more(part: DataFrame) -> None:
        nonlocal found
        part = part.select("ha", "hb", "first", "last")
        found = part if found is None else found.unionByName(part)

    while True:
        rows = cut(rows)
        sizes = cut(rows.groupBy("cell").agg(F.sum(F.octet_length("stretch")).alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        large = sizes.where(F.col("bytes") > INDEX_BYTES).select("cell")
        small = rows.join(sizes.where(F.col("bytes") <= INDEX_BYTES).select("cell"), "cell").select("ha", "hb", "cell", "first", "stretch")
        more(small.repartition("cell").sortWithinPartitions("cell", "first").mapInArrow(_by_index, "ha long, hb long, first int, last int"))
        if not large.limit(1).count():
            return found
        level += 1
        each = cut(rows.join(large, "cell").select(*rows.columns).mapInArrow(_halves(level), _SPLIT))
        kinds = each.groupBy("cell", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ha", "hb", "first")).alias("one"))
        again = kinds.where("n > 1").select("cell", "whole")
        more(each.join(again, ["cell", "whole"], "left_semi").withColumn("last", (F.col("first") + F.octet_length("stretch") - LENGTH).cast("int")))
        ones = kinds.select("cell", "whole", F.col("one.ha").alias("ha"), F.col("one.hb").alias("hb"), F.col("one.first").alias("first"))
        rows = each.join(ones, ["cell", "whole", "ha", "hb", "first"], "left_semi").select(*rows.columns)


def repeated_windows(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """ha, hb, spans: array<struct<first, last>> of the starts of the windows of each distinct text that occur more than once."""
    texts = _distinct_texts(docs, copied)
    schema = "ha long, hb long, anchor long, whole long, first int, last int, place int"
    with scratch_table(texts.mapInArrow(_find, schema)) as anchors:
        often = anchors.where("anchor is not null").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
        with scratch_table(anchors.join(often, "anchor", "left_semi")) as alive:
            kinds = cut(alive.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ha", "hb", "first", "last", "place")).alias("one")))
            equal = alive.join(kinds.where("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select("ha", "hb", "first", "last")
            several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
            wanted = cut(kinds.join(several, "anchor").select(F.col("anchor").alias("cell"), "whole", "one.*"))
            found = anchors.where("anchor is null").select("ha", "hb", "first", "last").unionByName(equal).unionByName(_indexed(_fetch(texts, wanted)))
            # As many spans as the text has stretches.
            return cut(found.groupBy("ha", "hb").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")))


def dedup_substrings(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Remove each byte of documents (doc_id, text) that a 200-byte string covers which also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes) and, if ``keep`` names
    further columns, kept_text and a struct ``rest`` of these. A character cut in two by a removed run's end is left out of kept_text.

    "Elsewhere" is any other position of any text, judged on the input; strings never cross texts. A null text counts as empty.
    ``doc_id`` may be null, of any type and need not identify a row. Rows that repeat stay, and each counts as elsewhere for the
    others. An empty table gives an empty result. Other columns are ignored.
    """
    rows = _named(docs, "doc_id", *(keep or []))
    copied = cut(rows.groupBy("ha", "hb").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ha", "hb"))
    spans = repeated_windows(docs, copied)
    # Of texts with copies every window occurs elsewhere.
    entry = spans.schema["spans"].dataType.simpleString()
    spans = spans.join(copied, ["ha", "hb"], "left_anti").unionByName(copied.withColumn("spans", F.lit(None).cast(entry))).withColumn("touched", F.lit(True))
    likely = marked(rows, spans, ["ha", "hb"])
    free = likely.where("not _maybe").drop("_maybe").withColumns({"spans": F.lit(None).cast(entry), "touched": F.lit(None).cast("boolean")})
    joined = likely.where("_maybe").drop("_maybe").join(spans, ["ha", "hb"], "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, 0):
                rows = []
                for text, found, touched in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if touched and found is None:
                        spans = [(0, len(text))] if len(text) >= LENGTH else []
                    else:
                        a, b = _merged(np.array([s["first"] for s in found or []], np.int64), np.array([s["last"] for s in found or []], np.int64) + LENGTH - 1)
                        spans = list(zip(a.tolist(), (b + 1).tolist()))
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    rest = b"".join([*kept, text[at:]])
                    removed = len(text) - len(rest)
                    rows.append((len(text), removed, len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep is not None else None))
                arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.string())]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep is not None:
                    arrays.append(pa.array([r[4] for r in rows], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays([part.column(3), *arrays], ["rest", *names])

    fields = ["bytes", "spans", "touched", "rest"]
    schema = T.StructType([rows.schema["rest"]])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")) + ((("kept_text", "string"),) if keep is not None else ()):
        schema = schema.add(name, kind)
    out = free.select(*fields).unionByName(joined.select(*fields)).mapInArrow(remove, schema)
    return out.select(F.col("rest.doc_id").alias("doc_id"), *out.columns[1:], *(["rest"] if keep is not None else []))


def op10_run_length_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
