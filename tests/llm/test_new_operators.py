import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm.hard_negatives import hard_negatives as mine
from echofold.llm.hard_negatives import products
from echofold.llm.periodic_runs import collapsed, find_runs, periodic_runs, repeat_a_tail, strongest, word_numbers
from echofold.llm.piece_merges import default_model, encode_pieces, merge_model, merge_symbols
from echofold.llm.queries import ORACLE_SQL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [" a  b\n\tc\0d <s> <0x0A> ▁x日本", "▁▁ ▁", "   ", "🙂é ﬁ", "<unk></s>", "x" * 3000, "日本語を" * 400, " lead and trail ", "the  thing"]


def test_pieces_equal_the_library(spark, docs, rows):
    more = [(20_000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(ODD)]
    out = encode_pieces(docs.unionByName(spark.createDataFrame(more, docs.schema)), keep_ids=True).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = []
    for r in rows + more:
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), ids))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in out) == sorted(want)
    assert all(r.agrees for r in out)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abeth in  ▁日本\n\0é🙂<0x>A"), max_size=200))
def test_agenda_makes_the_library_s_ids(text):
    model = merge_model(default_model())
    assert model.encode([text, text]) == ([model.library.encode(text)] * 2, [True] * 2)


def test_agenda_takes_best_then_leftmost():
    costs = {"ab": 1.0, "bc": 0.0, "aa": 2.0, "aaa": 3.0}
    assert merge_symbols("abc", costs) == ["a", "bc"]
    assert merge_symbols("aaaaa", costs) == ["aa", "aaa"]
    assert merge_symbols("", costs) == []


def test_words_of_a_batch_are_merged_as_alone():
    model = merge_model(default_model())
    words = ["▁the", "▁", "▁▁▁▁", "▁日本語é", "▁a\0b\0", "▁" + "ab" * 20, "▁🙂ing"]
    matrix = model.merge_words(words)
    assert [model.word_ids(row) for row in matrix] == [model._merge_alone(w) for w in words]
    model.known = {}
    assert model._learn(["▁" + "thing" * 30, *words]) == set() and model.known["▁"] == [model.library.piece_to_id("▁")]


def test_differences_from_the_library_are_told(monkeypatch):
    model = merge_model(default_model())
    monkeypatch.setattr(model, "known", {})
    monkeypatch.setattr(model, "_unlike", lambda own, theirs: [0])
    ids, agrees = model.encode(["b aa", "b", "", "aaaaaa"])
    assert ids == model.library.encode(["b aa", "b", "", "aaaaaa"]) and agrees == [False, False, True, True]


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(default_model(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merge type"):
        merge_model(str(tmp_path / "unigram.model"))


def test_empty_tables(spark, no_docs):
    assert encode_pieces(no_docs).count() == 0 and periodic_runs(no_docs).count() == 0
    assert mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def plain_runs(ids):
    out = []
    for q in range(1, len(ids) // 3 + 1):
        at = 0
        while at + q < len(ids):
            end = at
            while end + q < len(ids) and ids[end] == ids[end + q]:
                end += 1
            run = ids[at : end + q]
            smaller = any(all(run[k] == run[k + d] for k in range(len(run) - d)) for d in range(1, q))
            if len(run) >= max(24, 3 * q) and not smaller:
                out.append((at, len(run), q))
            at = end + 1
    return sorted(out)


def made_of_runs(r):
    ids = []
    for _ in range(r.randint(0, 6)):
        letters = r.choice([1, 2, 3, 50])
        if r.random() < 0.6:
            base = [r.randrange(letters) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
            size = max(r.choice([0, 24]), int(len(base) * r.choice([2, 2.9, 3, 3.1, 4, 7])))
            ids += [base[i % len(base)] for i in range(size)]
        else:
            ids += [r.randrange(letters) for _ in range(r.randint(0, 40))]
    return ids


def test_runs_equal_plain_search():
    r = random.Random(5)
    found = 0
    for _ in range(500):
        ids = made_of_runs(r)
        want = plain_runs(ids)
        found += len(want)
        assert find_runs(np.array(ids, np.int64)) == want
    assert found > 200


def test_long_periodic_sequences_take_no_square():
    assert find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    inner = np.tile(np.arange(5), 40_000)
    ids = np.concatenate([np.arange(10, 300), inner, np.arange(10, 300)])
    assert find_runs(ids) == [(290, 200_000, 5)]
    assert find_runs(np.tile(np.concatenate([inner[:90], np.arange(5, 55)]), 3))[0] == (0, 90, 5)


def test_runs_of_documents(spark, docs, rows):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words * 4 + ["end"]), "x\t" * 24, "x " * 23, "a b c " * 8 + "ñ " * 40, " ".join(words[:8] * 3 + words[9:20] * 6)]
    more = [(i, t, None, None, 0, None, None, None) for i, t in zip(range(30_000, 30_400), texts * 80)]
    more += [(None, texts[0], None, None, 0, None, None, None)]
    want = []
    planted = 0
    for r in rows + more:
        own = (r[1] or "").encode().split()
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 10 == 0 and own:
            planted += 1
            n, g = len(own), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(own) if len(own) < 400 else find_runs(word_numbers(own))
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        left = " ".join(w.decode() for i, w in enumerate(own) if i not in gone)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r[0], len(runs), *top, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(left), left))
    out = periodic_runs(docs.unionByName(spark.createDataFrame(more, docs.schema)), rewrite=repeat_a_tail, keep=True).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed_text"]
    assert sorted(([r[c] for c in names] for r in out), key=repr) == sorted(map(list, want), key=repr)
    assert planted > 20 and all(len(r.runs) == r.n_runs for r in out)


def test_strongest_run_is_compared_exactly():
    assert strongest([(0, 24, 8), (30, 30, 10), (70, 31, 10)]) == (70, 31, 10)
    assert strongest([(0, 24, 8), (30, 30, 10)]) == (0, 24, 8) and strongest([]) is None
    assert collapsed(list("abcabcabcx"), [(0, 9, 3)]) == list("abcx")


SCHEMA = "vec_id long, embedding array<float>, label int, score long, at string, number long"


def vector_rows():
    r = random.Random(3)
    base = [[r.gauss(0, 0.4) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in base[i % 6]], i % 7 % 4, 1, "x", 2) for i in range(700)]
    # A third of all rows are one vector, so scores tie; rows that repeat, among them an anchor.
    rows += [(1000 + i, rows[0][1], i % 3, 1, "x", 2) for i in range(350)]
    rows += [rows[5], rows[5], rows[200], rows[101]]
    rows += [(2000, None, 1, 1, "x", 2), (2100, [0.1] * 16, None, 1, "x", 2), (2200, [None] * 16, 1, 1, "x", 2), (2300, [float("nan")] * 16, 2, 1, "x", 2), (2400, [float("inf")] * 16, 2, 1, "x", 2)]
    rows += [(None, [0.5] * 16, 1, 1, "x", 2), (2500, [0.0] * 16, 3, 1, "x", 2), (2600, [-0.5] * 16, 9, 1, "x", 2)]
    return rows


@pytest.mark.parametrize("group_bytes", [32 << 20, 16 * 8 * 3])
def test_negatives_equal_sql(spark, group_bytes):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(vector_rows(), SCHEMA).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine(df.withColumn("label", moved), group_bytes=group_bytes, blocks=(2, 50))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(ORACLE_SQL["op13_blocked_gemm_negatives"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_products_are_exact_or_refused():
    big = np.array([[2.0**30, 1.0]])
    assert products(big, big).tolist() == [[2**60 + 1]]
    with pytest.raises(ValueError, match="64-bit"):
        products(big * 4, big * 4)


def test_vectors_of_unlike_lengths(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [2.0], 1), (2, [], 1), (3, [1.7], 2), (4, [1.0, 1.0, 9.0], 2)]
    got = mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), scale=1.0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 4, 2, 2)]
