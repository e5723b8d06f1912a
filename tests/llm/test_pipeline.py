import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tests.llm.test_dedup import removed_by_brute_force, shingles
from tests.llm.test_text_models import by_library

#: Names that the stages use themselves, too.
CLASHES = ["score", "check", "doc", "bytes", "packed", "spans", "kept_text", "key", "turns", "row", "id", "ha", "hb", "rest", "group", "words", "_maybe"]
SCHEMA = "doc_id string, text string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)


def full(doc_id, text, source):
    return (doc_id, text, source, len(text or ""), *[f"{c} of {doc_id}" for c in CLASHES])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    out = [(f"d{i:02}", prose(r.randint(5, 60)), ["s1", "s2", None][i % 3]) for i in range(20)]
    base = prose(60).split()
    for k in range(6):
        out.append((f"n{k}", " ".join(base[:k] + ["changed"] + base[k + 1 :]), "s1"))
    passage = prose(50)
    out += [(f"p{k}", prose(10) + "\n" + passage + "\n" + prose(12), "s2") for k in range(3)]
    # Unlike texts with one id, rows that repeat, nulls, texts without words.
    out += [("same", prose(30), "s1"), ("same", prose(40), "s1"), ("same", prose(35), "s1"), out[0], out[0], (None, prose(20), "s1"), (None, None, None), ("void", "", "s1"), ("void", "", "s1"), ("blank", " \n", None)]
    return [full(*x) for x in out]


def taken_over(out, rows):
    """Every row that is left is one of the input's."""
    assert not Counter(map(tuple, out)) - Counter(rows)


def test_near_dedup_stage(spark, rows):
    out = P.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    taken_over(out, rows)
    sets = [shingles(x[1], 5) for x in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    by_group = defaultdict(list)
    for i, x in enumerate(rows):
        by_group[group[i]].append((x[0] is None, x[0] or "", i))
    want = Counter(min(v)[1] for v in by_group.values())
    assert Counter(x["doc_id"] or "" for x in out) == want
    assert want["same"] == 3 and want["d00"] == 1 and want["void"] == 2


def test_substring_dedup_stage(spark, rows):
    out = P.substring_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = removed_by_brute_force(rows)
    assert len(out) == len(rows) and sum(n for (_, _, removed, _, _), n in want.items() if removed) > 2
    left = Counter((x["doc_id"], len(x["text"].encode())) for x in out)
    assert left == Counter({(k[0], k[1] - k[2]): 0 for k in want}) + sum((Counter({(k[0], k[1] - k[2]): n}) for k, n in want.items()), Counter())
    assert all(x["n_chars"] == len(x["text"]) and x["check"] == f"check of {x['doc_id']}" for x in out)


def test_mixing_stage(spark, rows):
    out = P.mixing_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size, taken, texts = Counter(), Counter(), defaultdict(set)
    for x in rows:
        size[x[2]] += len(word.findall(x[1] or ""))
        texts[x[0], x[2]].add(x[1])
    for x in out:
        taken[x["source"]] += len(word.findall(x["text"]))
        # Every part taken is a stretch of a text with this id and source.
        assert any(all(part in (t or "") for part in x["text"].split("\n")) for t in texts[x["doc_id"], x["source"]])
        assert x["n_chars"] == len(x["text"]) and x["key"] == f"key of {x['doc_id']}"
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    capped: set = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    assert all(abs(taken[s] - (2 * size[s] if s in capped else level * weight[s])) <= 1 for s in names)


def test_quality_stage(spark, rows, tmp_path):
    """What it keeps are whole rows; it keeps those that score_quality scores at 0.5 or more."""
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(f"{k}", k % 2) for k in range(9)], "doc_id string, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = P.quality_stage(spark, docs, str(tmp_path)).collect()
    assert Counter(map(tuple, out)) == Counter(rows)


def test_stages_without_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for stage in (P.near_dedup_stage, P.substring_dedup_stage, P.mixing_stage):
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert P.bpe_stage(spark, empty, "").count() == 0


def test_words_between():
    text = " one two\n three  four "
    assert P.words_between(text, [(0, 4)]) == text
    assert P.words_between(text, [(0, 2), (3, 4)]) == "one two\nfour"
    assert P.words_between(text, [(1, 3)]) == "two\n three"


def test_run(spark, rows, tmp_path):
    """Stage by stage and as a whole the result is the same; its ids are the library's for texts of the fourth stage."""
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(f"{k}", k % 2) for k in range(9)], "doc_id string, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    now = docs
    for name, stage in P.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
    texts = now.collect()
    assert texts and Counter((x["doc_id"], *by_library(x["text"])) for x in texts) == Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in out)
    assert all(len(x["ids"]) == x["n_tokens"] for x in out)
