import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from echofold.llm.mixing import _key, _plan_source, mix_sources, permuted
from echofold.llm.sharding import balanced_shards


def test_shards_are_even_whole_and_gapless(docs, rows):
    out = balanced_shards(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == {0, 1, 2, 3}
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    of_id = {r.doc_id: r.shard for r in out}
    by_text = defaultdict(set)
    for r in rows:
        if r[1] is not None:
            by_text[r[1]].add(of_id[r[0]])
    assert sum(len(s) > 1 for s in by_text.values()) == 0
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_group_larger_than_a_shard_is_split(spark):
    docs = spark.createDataFrame([(i, "same" if i < 70 else f"t{i}") for i in range(100)], "doc_id long, text string")
    out = balanced_shards(docs, shards=4).collect()
    assert Counter(r.shard for r in out) == {0: 25, 1: 25, 2: 25, 3: 25}


def test_hot_group_beside_many_small_ones(spark):
    """A third of the rows is one text, 900 rows are in groups of three: no small group is split, the hot one takes as few shards as hold it."""
    texts = ["hot"] * 2000 + [f"g{i % 300}" for i in range(900)] + [f"t{i}" for i in range(3100)]
    out = balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8).collect()
    assert Counter(r.shard for r in out) == dict.fromkeys(range(8), 750)
    by_text = defaultdict(set)
    for r in out:
        by_text[texts[r.doc_id]].add(r.shard)
    assert len(by_text["hot"]) == 3
    assert sum(len(v) > 1 for t, v in by_text.items() if t[0] == "g") == 0


def test_no_group_is_split_where_all_fit(spark):
    """No row is without links: what fits no best shard goes whole to another, large groups first."""
    texts = [f"large{i}" for i in range(8) for _ in range(300)] + [f"g{i}" for i in range(400) for _ in range(3)]
    out = balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8).collect()
    assert Counter(r.shard for r in out) == dict.fromkeys(range(8), 450)
    by_text = defaultdict(set)
    for r in out:
        by_text[texts[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in by_text.values()) == 0


def test_no_documents_give_no_shards(no_docs):
    assert balanced_shards(no_docs).count() == 0


def test_permutation_and_inverse():
    for size in (1, 2, 3, 10, 1000):
        key = np.full(size, 12345, np.uint64)
        there = permuted(np.arange(size), np.full(size, size), key)
        assert sorted(there.tolist()) == list(range(size))
        assert (permuted(there, np.full(size, size), key, inverse=True) == np.arange(size)).all()


def test_a_source_plan_meets_its_words():
    for size in range(1, 40):
        for wanted in range(0, 2 * size + 1):
            blocks, passes, slots, last, total = _plan_source(size, wanted, 1, 4, 2, 17)
            words = passes * size
            if slots:
                at = permuted(np.arange(slots), np.full(slots, blocks), _key(np.full(slots, 1), np.full(slots, passes), 17))
                each = np.minimum(4, size - at * 4)
                assert 0 < last <= each[-1]
                words += int(each[:-1].sum()) + last
            assert words == wanted and total == passes * blocks + slots


def test_mixing_meets_targets(docs, rows):
    out = mix_sources(docs, block=16, keep_spans=True).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    per_source = Counter()
    for r in rows:
        per_source[r[3]] += size[r[0]]
    names = sorted((s for s in per_source if s is not None)) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    left, capped = 1.5 * sum(per_source.values()), set()
    while True:
        level = (left - sum(2 * per_source[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 2 * per_source[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * per_source[s] if s in capped else level * weight[s] for s in names}
    taken = Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == per_source[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert sum(s["last"] - s["first"] for s in r.spans or []) == r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mix_sources(docs.repartition(2), block=16).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in out)


def test_mixing_without_words(spark, no_docs):
    assert mix_sources(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mix_sources(blank).collect()] == [(0, 0, 0.0)] * 2
