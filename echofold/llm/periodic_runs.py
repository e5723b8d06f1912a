"""Runs of repeating words, found by matching aligned blocks of a power of two words at the distances that fit their size.

A run with period q of B or more but less than 2 B words (of 1 to 15 for B = 8) is long enough to hold a block of B words that begins at a
multiple of B and comes again q words further on. So at each scale B an automaton holds the text's aligned blocks as sequences of integers, one
per word, and is run over the text. An occurrence that follows its block at such a distance is a seed, which is extended to both sides, word by
word, as far as the period holds. Each word of a run occurs in it three times at least; what lies between rarer words is searched on its own, if it's long enough.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.spark_util import parts_by_bytes

#: Shortest run in words, fewest periods in a run, and words of the smallest block.
MIN_WORDS, MIN_PERIODS, BLOCK = 24, 3, 8
Run = tuple[int, int, int]


def word_numbers(words: list) -> np.ndarray:
    """A number for each word, the same for equal words."""
    numbers: dict = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _agree_until(ids: np.ndarray, q: int, at: int) -> int:
    """The first place from ``at`` on whose word isn't the one q further on."""
    end, width = len(ids) - q, 64
    while at < end:
        stop = min(at + width, end)
        odd = ids[at:stop] != ids[at + q : stop + q]
        if odd.any():
            return at + int(odd.argmax())
        at, width = stop, 2 * width
    return end


def _agree_since(ids: np.ndarray, q: int, at: int) -> int:
    """The first place from which all words before ``at`` are the ones q further on."""
    width = 64
    while at > 0:
        low = max(0, at - width)
        odd = ids[low:at] != ids[low + q : at + q]
        if odd.any():
            return at - int(odd[::-1].argmax())
        at, width = low, 2 * width
    return 0


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Longest stretches, of ``least`` words or more, of words that occur MIN_PERIODS times in the text."""
    often = np.bincount(ids)[ids] >= MIN_PERIODS
    edge = np.flatnonzero(np.diff(often, prepend=False, append=False))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def _seeds(ids: np.ndarray, stretches: list[tuple[int, int]], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where aligned blocks begin that come again at a distance that fits their size, and these distances."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    numbers = np.full(len(ids) // block + 1, -1, np.int64)
    words = [tuple(ids[a:b].tolist()) for a, b in stretches]
    for (a, b), sequence in zip(stretches, words):
        for at in range(-(-a // block) * block, b - block + 1, block):
            key = sequence[at - a : at - a + block]
            number = automaton.get(key, -1)
            if number < 0:
                number = at
                automaton.add_word(key, number)
            numbers[at // block] = number
    if not len(automaton):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton.make_automaton()
    found = [np.array(list(automaton.iter(sequence)), np.int64).reshape(-1, 2) + (a - block + 1, 0) for (a, _), sequence in zip(stretches, words)]
    starts, which = np.concatenate(found).T
    # One aligned place lies from B to 2 B - 1 words before a word; in the smallest scale one may lie nearer.
    places = [starts // block * block - block] + ([starts // block * block] if block == BLOCK else [])
    at = np.concatenate(places)
    starts, which = np.tile(starts, len(places)), np.tile(which, len(places))
    good = (at >= 0) & (at < starts)
    good &= numbers[np.where(good, at, 0) // block] == which
    at, distance = at[good], (starts - at)[good]
    order = np.lexsort((at, distance))
    return at[order], distance[order]


def _without_insides(stretches: list[tuple[int, int]], runs: list[tuple[int, int]], block: int) -> list[tuple[int, int]]:
    """What is left to search at a scale once runs of smaller periods are known.

    Two runs share fewer words than their periods together, so fewer than 3 blocks here, and no run of this scale has a run of 3 blocks within it. Such
    a run's inside can go, and so can its ends where no more than a block of words stands beside them.
    """
    for a, b in runs:
        low, high = a + 3 * block, b - 3 * block
        if b - a < 3 * block:
            continue
        out = []
        for s, e in stretches:
            if e <= min(low, high) or s >= max(low, high):
                out.append((s, e))
                continue
            if a - s > block:
                out.append((s, min(e, low)))
            if e - b > block:
                out.append((max(s, high), e))
        stretches = out
    return sorted(set(stretches))


def find_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period), by start and period, of the runs in a sequence of numbers.

    A run has MIN_WORDS words or more and MIN_PERIODS periods or more, none of its neighbours continues its period, and no smaller period holds in it.
    """
    n = len(ids)
    periods: dict[tuple[int, int], int] = {}
    stretches = whole = _stretches(ids, MIN_WORDS) if n >= MIN_WORDS else []
    # Which run, of those found, holds a word (the first of several), and their ends and periods.
    holder, ends, own = np.full(n if stretches else 0, -1, np.int64), [0], [1]
    block = BLOCK
    while stretches:
        at, distance = _seeds(ids, stretches, block)
        held = holder[at]
        # Within a run of period p the words also agree at its multiples; this says nothing new.
        new = (held < 0) | (at + distance + block > np.array(ends)[held]) | (distance % np.array(own)[held] != 0)
        done: dict[int, int] = {}
        for p, q in zip(at[new].tolist(), distance[new].tolist()):
            if p < done.get(q, 0):
                continue
            k = holder[p]
            if k >= 0 and p + q + block <= ends[k] and q % own[k] == 0:
                continue
            start, stop = _agree_since(ids, q, p), _agree_until(ids, q, p + block)
            done[q] = stop
            stop += q
            if stop - start >= max(MIN_WORDS, MIN_PERIODS * q):
                periods[start, stop] = min(q, periods.get((start, stop), q))
                place = holder[start:stop]
                place[place < 0] = len(ends)
                ends.append(stop)
                own.append(q)
        block *= 2
        stretches = [(a, b) for a, b in _without_insides(whole, list(periods), block) if b - a >= MIN_PERIODS * block]
    # Where a smaller period holds as well, it was found with the same ends.
    return sorted((a, b - a, q) for (a, b), q in periods.items())


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run has after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with most periods; of equal ones that which starts first, then that of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, keep: bool = False) -> DataFrame:
    """Runs in the words (whatever stands between space and 09-0D) of documents (doc_id, text).

    Returns doc_id, n_runs, start, length, period, exponent_milli of the run with most periods, runs_sha256 (of the lines `start,length,period`),
    collapsed_sha256 (of the words left, joined by spaces) and, if asked for, runs as array<struct<start, length, period>> and
    collapsed_text. ``rewrite`` is given doc_id and the words and returns the words to be searched.

    A null, empty or blank text has no words and no run: nulls for the run and digests of nothing. Texts are searched whole; memory grows with the
    longest one, by some 100 bytes a word. Of runs with equally many periods the first in the text counts, then the one with the
    smaller period. ``doc_id`` may be null, of any type and need not identify a row; rows that repeat stay, each with its result. An empty
    table gives an empty result. Other columns are ignored. No shuffle.
    """
    rows = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("bytes"))
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    digests = ["runs_sha256", "collapsed_sha256"]
    triple = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, 1):
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = (text or b"").split()
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    runs = find_runs(word_numbers(words))
                    best = strongest(runs)
                    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                    left = b" ".join(collapsed(words, runs) if runs else words)
                    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    whole = ([dict(zip(("start", "length", "period"), r)) for r in runs], left.decode()) if keep else ()
                    out.append((len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), *whole))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.list_(triple), pa.string()] if keep else [])
                arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *numbers, *digests, *(["runs", "collapsed_text"] if keep else [])])

    schema = T.StructType([rows.schema["doc_id"]])
    for name in numbers:
        schema = schema.add(name, "long")
    for name in digests:
        schema = schema.add(name, "string")
    if keep:
        schema = schema.add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))).add("collapsed_text", "string")
    return rows.mapInArrow(search, schema)


def repeat_a_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """In one document of ten, by its id's checksum, the words from some place on repeat the first of them; without an id, in none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_block_match_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=repeat_a_tail)
