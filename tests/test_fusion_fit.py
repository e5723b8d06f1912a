import numpy as np
import pytest

from echofold.operators import fusion

KINDS = "id long, class string, x array<double>"


def test_distances_equal_numpy(spark):
    g = np.random.default_rng(4)
    mix = {c: g.normal(size=(5, 5)) for c in "ab"}
    rows = [(k, c, (g.normal(size=5) @ mix[c] + k % 3).tolist()) for k in range(300) for c in "ab"]
    rows += [(900, "one", [1.0] * 5), (901, "mixed", [1.0]), (902, "mixed", [1.0, 2.0]), (903, "a", None), (904, "a", [1.0, float("nan"), 0.0, 0.0, 0.0]), (905, "a", [1.0, None, 0.0, 0.0, 0.0]), (906, "a", [1.0]), (907, None, [1.0] * 5), (908, "new", [1.0] * 5)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    fits = fusion.gaussian_fit(df.where("class <> 'new' and id <> 906"), "class", "x", shrinkage=0.1)
    table = {r["class"]: r for r in fits.collect()}
    assert {c: (r["n"], r["refusal"]) for c, r in table.items()} == {"a": (300, None), "b": (300, None), "one": (1, "too_few"), "mixed": (1, "mixed_sizes")}
    got = {(r["id"], r["class"]): r["distance"] for r in fusion.gaussian_distance(df, fits, "class", "x").collect()}
    assert len(got) == len(rows)
    for c in "ab":
        x = np.array([r[2] for r in rows if r[1] == c and r[0] < 300])
        cov = np.cov(x.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-6 * np.eye(5)
        want = np.sqrt(np.einsum("ni,ij,nj->n", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0)))
        assert [got[k, c] for k in range(300)] == pytest.approx(want.tolist())
        assert 0.95 < (want <= table[c]["threshold"]).mean() <= 1.0
    assert all(got[k] is None for k in got if k[0] >= 900)


def test_no_rows(spark):
    none = spark.createDataFrame([], KINDS)
    fits = fusion.gaussian_fit(none, "class", "x")
    assert fits.count() == 0 and fusion.gaussian_distance(none, fits, "class", "x").count() == 0
