import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.llm import substring_dedup
from echofold.llm.components import components
from echofold.llm.minhash import near_duplicates
from echofold.llm.quality_rules import measures, quality_rules
from echofold.llm.substring_dedup import dedup_substrings, matching_statistics


def shingles(text, size):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_by_brute_force(rows, size):
    sets = {r[0]: shingles(r[1], size) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(docs, rows):
    for size in (4, 5):
        want = near_by_brute_force(rows, size)
        out = near_duplicates(docs, words=size).collect()
        assert len(out) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == want


def test_near_duplicates_in_a_large_family(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    texts = []
    for k in range(120):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            t[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == near_by_brute_force(rows, 4)


def test_no_documents(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert dedup_substrings(no_docs).count() == 0
    assert quality_rules(no_docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100)], "a long, b long")
    out = {r.node: r.component for r in components(edges).collect()}
    assert out == {i: 0 for i in range(41)} | {99: 99, 100: 99}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=4))
def test_matching_statistics_equal_brute_force(texts):
    suffixes = [t[i:] for t in texts for i in range(len(t))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [max([common(a, b) for j, b in enumerate(suffixes) if j != i], default=0) for i, a in enumerate(suffixes)]
    assert matching_statistics(texts).tolist() == want


def removed_by_brute_force(rows):
    count = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[i : i + 200] for i in range(len(b) - 199))
    out = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(r[0], len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest())] += 1
    return out


def test_substrings_equal_brute_force(docs, rows):
    out = dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == removed_by_brute_force(rows)


def test_substrings_in_cells_that_are_divided(spark, docs, rows, monkeypatch):
    """Cells above a few hundred bytes are halved by the anchor's offset, down to single windows, with the same result."""
    r = random.Random(5)
    common = "".join(r.choice("abcdefgh ") for _ in range(230))
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(0, 90))) + common[r.randint(0, 60) : 230 - r.randint(0, 60)] + "".join(r.choice("efgh") for _ in range(r.randint(0, 90))) for _ in range(60)]
    more = [(5000 + i, t) for i, t in enumerate(texts)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for size in (1, 900):
        monkeypatch.setattr(substring_dedup, "INDEX_BYTES", size)
        out = dedup_substrings(both).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == removed_by_brute_force(rows + more)


def test_substrings_with_odd_ids_and_columns(spark):
    """Ids that are no numbers, null or repeated for unlike texts, and columns named like the operator's own."""
    passage = "The passage that comes again, in every one of these, word for word. " * 4
    rows = [("a", passage + "x" * 300, "1"), ("a", "y" + passage, "2"), (None, passage, "3"), ("b", "short", "4"), ("b", None, None), ("c", passage + "x" * 300, "6")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, bytes string").withColumns({c: F.lit("z") for c in ("ha", "spans", "rest", "kept_text", "cell")})
    out = dedup_substrings(docs, keep=["bytes", "ha", "spans", "rest", "kept_text", "cell"]).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == removed_by_brute_force(rows)
    assert {r.rest["bytes"]: r.kept_text for r in out} == {"1": "", "2": "y", "3": "", "4": "short", None: "", "6": ""}
    assert {r.rest["kept_text"] for r in out} == {"z"}


def test_substrings_across_segments(spark):
    """A text longer than a segment, with a passage across its border, and ones that repeat themselves with a short period."""
    r, border = random.Random(9), substring_dedup._SEGMENT
    long = "".join(r.choice("abcdefghij ") for _ in range(border + 5000))
    rows = [(1, long), (2, "q" * 3 + long[border - 150 : border + 300]), (3, "Orre " * 700), (4, "x" + "Orre " * 60)]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == removed_by_brute_force(rows)


def measures_by_brute_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules_equal_brute_force(docs, rows):
    out = quality_rules(docs).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        want = measures_by_brute_force(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_longest_repeat_and_spans():
    same = b"one two three four five six"
    (row,) = measures([same + b" x y " + same + b" z\nline\nline\n \n \n"])
    assert row[5:] == (12, 6) and row[3] == 1
