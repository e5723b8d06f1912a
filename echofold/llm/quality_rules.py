"""Repetition and shape rules for documents, with repeats found by word suffix arrays.

The suffixes of a text, by words, are sorted by prefix doubling; ranks of every doubling step are kept and give the
longest common prefix of neighbours in the order. The longer of a suffix's two common prefixes is the longest repeat
that starts there (the depth of the LCP interval that it lies in), and the union of these spans over all positions is the
part of the text that maximal repeated substrings cover. Many texts share one array: their suffixes sort text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.spark_util import parts_by_bytes
from echofold.llm.suffixes import suffix_order
from echofold.llm.words import SPACE, many_word_hashes

#: Fixed values of the contract.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: The method's own limits: share of words inside repeats of at least SPAN words, and words in the longest repeat.
SPAN = 5
MAX_COVERED = 0.3
MAX_LONGEST = 100
#: Words whose suffixes are sorted together; a longer text is sorted alone.
GROUP = 1 << 15

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_POINT = (np.arange(256) & 0xC0) != 0x80
_WORD_POINT = _POINT & ~SPACE


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest run from there that also starts elsewhere in the same text.

    ``words`` are the concatenated word hashes and ``text`` says (ascending) which text each belongs to.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
    end = np.searchsorted(text, text, side="right")
    order, levels = suffix_order(text.astype(np.int64) * n + ids, end, 1)
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in reversed(range(len(levels))):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b]) & (text[a] == text[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same << k
    out = np.zeros(n, np.int64)
    if n > 1:
        out[a] = common
        out[b] = np.maximum(out[b], common)
    return out


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Whether each position lies in a repeat of at least ``least`` words."""
    change = np.zeros(len(repeats) + 1, np.int64)
    at = np.flatnonzero(repeats >= least)
    change[at] += 1
    np.subtract.at(change, at + repeats[at], 1)
    return np.cumsum(change[:-1]) > 0


def _group_measures(texts: list[bytes], words: list[np.ndarray]) -> list[tuple]:
    sizes = np.array([len(w) for w in words])
    text = np.repeat(np.arange(len(words)), sizes)
    repeats = longest_repeats(np.concatenate(words), text)
    bounds = np.concatenate([[0], np.cumsum(sizes)])

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    in_window, in_span = per_text(covered(repeats, WINDOW)), per_text(covered(repeats, SPAN))
    out = []
    for i, data in enumerate(texts):
        raw = np.frombuffer(data, np.uint8)
        lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        longest = int(repeats[bounds[i] : bounds[i + 1]].max(initial=0))
        out.append(
            (int(sizes[i]), int(_WORD_POINT[raw].sum()), int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), int(in_window[i]), int(in_span[i]), longest)
        )
    return out


def measures(texts: list[bytes]) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_span_words, longest_repeat of each text."""
    out, group, held = [], [], 0
    hashes = many_word_hashes(texts)
    for data, words in zip(texts, hashes):
        if held and held + len(words) > GROUP:
            out += _group_measures([g[0] for g in group], [g[1] for g in group])
            group, held = [], 0
        group.append((data, words))
        held += len(words)
    if group:
        out += _group_measures([g[0] for g in group], [g[1] for g in group])
    return out


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Measures and verdicts for documents (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_span_words (in repeats
    of at least 5 words) and longest_repeat (words). ``kept`` is false where the base fails, where more than
    ``max_covered`` of the words lie in repeats, or where one repeat is longer than ``max_longest`` words.

    A null or empty text has no words and fails the base. Rows that repeat are judged alike, one result each. An
    empty table gives an empty result. Other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_span_words", "longest_repeat"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, 1):
                texts = [x or b"" for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                rows = measures(texts)
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = (F.col("n_span_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)


def op6_suffix_array_repetition(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*base, "n_span_words")
