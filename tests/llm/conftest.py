import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hub string, label int, rank long"


def make_rows():
    """Copies, near copies, a shared passage, nulls, empty, blank and long texts, repeated rows, extra clashing columns."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)] + ["Été", "ñandú", "größe", "日本"]

    def prose(n):
        return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))

    texts = [prose(r.randint(1, 120)) for _ in range(30)]
    base = prose(150).split(" ")
    for k in range(25):
        near = list(base)
        for _ in range(1 + k % 3):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [texts[3]] * 12
    passage = prose(60)
    texts += [prose(20) + "\n" + passage + "\n" + prose(25) for _ in range(4)]
    texts += ["Orre " * 300, "a b c", "A B c", "a b", "", None, None, "   \n\t", "no_spaces_at_all" * 40, prose(3000), "日本語" * 150]
    rows = [(i, t, "en" if i % 3 else None, [None, "s1", "s2", "s3"][i % 4], len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
