import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echofold.llm import bpe
from echofold.llm.bpe import chunk_ends, chunks, default_tokenizer, encode_chunk, encode_documents, encode_with_chunks
from echofold.llm.language_id import identify_languages
from echofold.llm.quality_model import FEATURES, fit, is_held_out, quality_scores, score_quality, train


def by_library(text):
    t = Tokenizer.from_file(default_tokenizer())
    ids = t.encode(text, add_special_tokens=False).ids
    decoded = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_equals_the_library(spark, docs, rows):
    odd = [
        "it's  two   spaces\tand\n\n tabs <|endoftext|> mid <|endoftext|>",
        "x\u00a0y \u3000 z 12 345 don't we'll  ",
        ("The same long passage again, word for word, in this place. " * 40) + "end",
        "start " + ("The same long passage again, word for word, in this place. " * 40),
    ]
    odd += ["Another beginning, then " + max((r[1] or "" for r in rows), key=len) + " and another end."]
    more = [(10_000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(odd)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = encode_documents(both, keep_ids=True).collect()
    want = Counter((r[0], *by_library(r[1] or "")) for r in rows + more)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert sum(r.n_reused for r in out) > 0 and all(len(r.ids) == r.n_tokens for r in out)


def test_bpe_without_documents(no_docs):
    assert encode_documents(no_docs).count() == 0


def check_chunks(text):
    """Every chunk of the text that can be taken over is; the ids are the library's."""
    data, path = text.encode(), default_tokenizer()
    ends = chunk_ends(np.frombuffer(data, np.uint8))
    assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
    given = [(a, encode_chunk(data[a:b], path)) for a, b, _, _ in chunks(data)]
    ids, taken = encode_with_chunks(data, [(a, c) for a, c in given if c is not None], path)
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    return taken


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab. \n'sé1\u00a0日"), max_size=3000))
def test_joins_are_repaired(text):
    check_chunks(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word ", "слово ", "日本語の", "  \n   ", "\n", "12345", "don't ", "...", "<|endoftext|>", "<|endof", " " * 70, "é"]), max_size=400))
def test_joins_are_repaired_in_any_script(parts):
    check_chunks("".join(parts))


def test_chunks_are_taken_over_in_any_script():
    r = random.Random(8)
    for words in (["river", "house", "of"], ["слово", "дом", "и"], ["日本語", "の文章", "。"]):
        text = "".join(r.choice(words) + r.choice([" ", " ", ", "]) for _ in range(2000))
        assert check_chunks(text) > 1000


def test_bpe_of_other_tokenizers(spark):
    """One that drops white space and case is used without reuse; results are the library's."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not bpe.splits_locally(path) and bpe.splits_locally(default_tokenizer())
    text = "The same long passage again, word for word. " * 30
    out = encode_documents(spark.createDataFrame([("a", text), ("a", text + "x"), (None, None)], "doc_id string, text string"), path).collect()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for r in out:
        ids = t.encode(next(x for x in (text, text + "x", "") if len(t.encode(x, add_special_tokens=False).ids) == r.n_tokens), add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_reused == 0
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    good = ["the", "of", "and", "to", "in", "house", "river", "walks", "over", "green"]
    rows, labels = [], []
    for i in range(240):
        n = r.randint(8, 60)
        if i % 4:
            text = " ".join(r.choice(good) for _ in range(n)) + "."
        else:
            text = r.choice([" ".join(r.choice(good).upper() + "!!" for _ in range(n)), " ".join([r.choice(good)] * n), " | ".join(r.choice(good) + "$$$" for _ in range(n))])
        rows.append((i, text, "zz", "zz"))
        labels.append((i, int(i % 4 > 0), 0))
    rows += [(900, None, None, None), (901, "", None, None), (0, rows[0][1], "zz", "zz")]
    labels += [(1000, None, None), (None, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, features string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(labelled):
    docs, labels = labelled
    out = quality_scores(docs, labels).collect()
    assert len(out) == docs.count()
    seen = [r for r in out if r.held_out and r.doc_id < 240]
    assert len(seen) > 50
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in seen]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    again = {r.doc_id: r.score for r in quality_scores(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_quality_learns_nothing_from_the_held_out_fold(labelled):
    docs, labels = labelled
    _, net = fit(docs, labels)
    _, other = fit(docs, labels.where(~is_held_out("doc_id")))
    assert all((a == b).all() for a, b in zip(net.weights, other.weights))


def test_quality_without_labels_or_documents(labelled, no_docs):
    docs, labels = labelled
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(no_docs, labels).count() == 0
    vectors, net = fit(docs, labels)
    assert score_quality(docs, vectors, net).columns == ["doc_id", "text", "features", "score"]
    assert score_quality(docs, vectors, net, "p").columns == ["doc_id", "text", "score", "features", "p"]


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, FEATURES))
    y = (r.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = train(x[:2000], y[:2000])
    p = net.scores(x[2000:])
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        inside = (p >= low) & (p < high)
        assert abs(p[inside].mean() - y[2000:][inside].mean()) < 0.12


def test_trigrams_across_parts(spark, monkeypatch):
    from echofold.llm import language_id

    docs = spark.createDataFrame([("Über den Fluss und in die Wälder gehen wir", "de"), ("a", "de"), ("the river and the house", "en")], "text string, lang string")
    whole = language_id.train_languages(docs)
    monkeypatch.setattr(language_id, "PART", 5)
    parts = language_id.train_languages(docs)
    assert whole[0] == parts[0] and (whole[1] == parts[1]).all()


def test_languages_from_fused_evidence(spark, no_docs):
    words = {"en": "the of and that with this house river", "de": "der die und nicht mit haus über fluss", "fr": "le la les avec maison rivière être où"}
    r = random.Random(2)

    def prose(lang, n):
        return " ".join(r.choice(words[lang].split()) for _ in range(n))

    docs = spark.createDataFrame([(prose(lang, 40), lang) for lang in words for _ in range(20)] + [("?", None), (None, "en")], "text string, lang string")
    pages, truth = [], {}
    for i in range(60):
        lang = list(words)[i % 3]
        body = prose(lang, 1 if i % 7 == 0 else 30)
        pages.append((i, f"https://{lang}{i % 2}.example.org/{lang}/{i}", f'<html lang="{lang}"><script>the of and</script><p>{body}</p></html>', "x"))
        truth[i] = lang
    # Only the host tells; only the markup tells; nothing tells.
    pages += [(100, "http://fr1.example.org/", None, "x"), (101, None, '<html lang="de">', "x"), (102, "nothing", "", "x"), (102, "nothing", "", "x")]
    out = identify_languages(spark.createDataFrame(pages, "page_id long, url string, html string, best string"), docs).collect()
    got = {r.page_id: r.lang for r in out}
    assert len(out) == len(pages) and all(got[i] == truth[i] for i in truth)
    assert got[100] == "fr" and got[101] == "de"
    assert all(0 < r.probability <= 1 for r in out)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert identify_languages(empty, docs).count() == 0
    unlabelled = identify_languages(spark.createDataFrame(pages[:2], "page_id long, url string, html string, x string"), docs.where("lang is null"))
    assert [r.lang for r in unlabelled.collect()] == [None, None]
