import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.functions import table_functions as T
from echofold.operators import decorrelation as D


def call(spark, rows, schema, sql):
    T.register_table_functions(spark)
    spark.createDataFrame(rows, schema).repartition(3).createOrReplaceTempView("t_rows")
    return sorted((tuple(r) for r in spark.sql(sql).collect()), key=repr)


def test_claims_are_the_first_of_each_tenant(spark):
    rows = [(t, f"r{k}", float(k % 5)) for t in "ab" for k in range(20)] + [("a", "none", None), (None, "x", 0.0)]
    got = call(spark, rows, "tenant string, record_id string, next_attempt_at double", "SELECT * FROM claim_pending(TABLE(t_rows) PARTITION BY (tenant) ORDER BY (next_attempt_at, record_id), 6, 1.0D)")
    first = [f"r{k}" for k in (0, 10, 15, 5, 1, 11)]
    assert got == sorted([(t, r, float(int(r[1:]) % 5), n) for t in "ab" for n, r in enumerate(first, 1)] + [(None, "x", 0.0, 1)], key=repr)


def test_retention_of_partitions(spark):
    rows = [("d1", True, 1.0), ("d1", True, 2.0), ("d2", True, 1.0), ("d2", False, 1.0), ("d3", True, 10.0), ("d4", True, None)]
    got = call(spark, rows, "day string, finished boolean, received_at double", "SELECT * FROM enforce_retention(TABLE(t_rows) PARTITION BY (day), 5.0D)")
    assert got == [("d1", 2, 0, "drop"), ("d2", 2, 1, "unfinished_rows"), ("d3", 1, 0, "within_horizon"), ("d4", 1, 0, "within_horizon")]


def test_payloads_and_unrouted(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("a", "1", "x", sha("x")), ("a", "2", "x", sha("y")), ("a", "3", None, sha("")), ("b", "4", "é", None), ("b", "5", "", sha(""))]
    got = call(spark, rows, "tenant string, record_id string, body string, sha256 string", "SELECT * FROM verify_payload_integrity(TABLE(t_rows) PARTITION BY (tenant))")
    assert got == [("a", "2", sha("y"), sha("x")), ("a", "3", sha(""), None), ("b", "4", None, sha("é"))]
    got = call(spark, [("a", "x"), ("a", "x"), ("a", "k"), ("b", None)], "tenant string, class string", "SELECT * FROM unrouted_records(TABLE(t_rows) PARTITION BY (tenant), 'k,l')")
    assert got == [("a", "x", 2), ("b", None, 1)]


def test_names_are_given_once(spark):
    own = T.Registry("thing", one=min)
    own.register("two", max)
    assert own.names() == ["one", "two"] and own["two"] is max
    with pytest.raises(ValueError, match="of the name one"):
        own.register("one", max)
    with pytest.raises(ValueError, match="known are one, two"):
        own["three"]
    rows = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("a", None), ("b", 0.2)], "e string, p double")
    assert {r["e"]: (r["n"], round(r["p"], 6)) for r in T.fused(rows, "e", "p", "logodds").collect()} == {"a": (2, 0.75), "b": (1, 0.2)}


def test_models_by_name_on_held_out_blocks(spark):
    g = np.random.default_rng(2)
    rows = [(k % 10, "c", g.normal(size=4).tolist()) for k in range(1000)]
    df = spark.createDataFrame(rows, "block long, c string, x array<double>")
    for how in ("gaussian", "axes"):
        got = T.held_out_rates(df, "block", "c", "x", how, F.col("block") >= 8).collect()
        assert sorted((r["block"], r["held_out"], r["n"]) for r in got) == [(b, b >= 8, 100) for b in range(10)]
        assert sum(r["n_above"] for r in got) < 30


def plain(x, t, rho=0.5, n_lags=48, min_pairs=8, cap=None):
    order = np.argsort(t, kind="stable")
    x, t = np.asarray(x, float)[order], np.asarray(t, float)[order]
    gaps = np.diff(t)
    dt = float(np.median(gaps[gaps > 0]))
    cap = (t[-1] - t[0]) / 4 if cap is None else cap
    most = min(int(cap / dt), len(t) - 2)
    z = x - x.mean(0)
    norm = np.linalg.norm(z, axis=1)
    lev = norm - norm.mean()
    curve = []
    for k in np.unique(np.round(np.geomspace(1, most, n_lags)).astype(int)):
        i = np.arange(len(t) - k)
        sep = t[i + k] - t[i]
        ok = (norm[i] > 0) & (norm[i + k] > 0) & (sep >= 0.5 * k * dt) & (sep <= 1.5 * k * dt)
        if ok.sum() < min_pairs:
            continue
        a = i[ok]
        cos = float((np.einsum("ij,ij->i", z[a], z[a + k]) / (norm[a] * norm[a + k])).mean())
        level = float((lev[a] * lev[a + k]).mean() / lev.var()) if lev.var() > 0 else 0.0
        curve.append((int(k), float(np.median(sep[ok])), max(cos, level), int(ok.sum()), "level" if level >= cos else "direction"))
    above = [j for j, c in enumerate(curve) if c[2] >= rho]
    channel = curve[above[-1]][4] if above else None
    if above and above[-1] == len(curve) - 1:
        return cap, most, None, channel, True
    hit = curve[above[-1] + 1] if above else curve[0]
    return hit[1], hit[0], hit[3], channel, False


def series(kind, n=400, seed=1):
    g = np.random.default_rng(seed)
    t = 100.0 + np.cumsum(g.choice([1.0, 1.0, 1.0, 2.5, 9.0], n))
    if kind == "noise":
        return t, g.normal(size=(n, 3))
    slow = np.cumsum(g.normal(size=(n, 3)), axis=0) if kind == "walk" else np.sin(t[:, None] / 60 + np.arange(3))
    if kind == "level":
        return t, g.normal(size=(n, 3)) * (2 + 1.9 * np.sin(t / 200))[:, None]
    return t, slow + 0.1 * g.normal(size=(n, 3))


def test_lags_equal_numpy(spark):
    rows, want = [], {}
    for kind in ("noise", "walk", "swing", "level"):
        t, x = series(kind)
        rows += [(kind, float(a), b.tolist()) for a, b in zip(t, x)]
        want[kind] = plain(x, t)
    # Rows without an anchor take no part.
    rows += [("noise", None, [9.0, 9.0, 9.0]), ("noise", 0.0, [9.0, 9.0, 9.0]), ("noise", float("nan"), [9.0, 9.0, 9.0])]
    got = {r["k"]: r for r in D.decorrelation(spark.createDataFrame(rows, "k string, t double, x array<double>").repartition(3), "k", "t", "x").collect()}
    for kind, (lag, k, n_pairs, channel, censored) in want.items():
        r = got[kind]
        assert (r["lag_rows"], r["n_pairs"], r["channel"], r["censored"], r["refusal"]) == (k, n_pairs, channel, censored, None), kind
        assert r["lag_s"] == pytest.approx(lag)
    assert {w[4] for w in want.values()} == {True, False} and want["noise"][1] == 1


def test_series_that_are_refused(spark):
    t, x = series("noise", 40)
    rows = [("few", 1.0, [1.0]), ("few", 2.0, [1.0]), ("none", None, [1.0]), ("still", 5.0, [1.0])] + [("still", 5.0, [float(k)]) for k in range(5)]
    rows += [("nan", float(k + 1), [float("nan") if k == 3 else 1.0]) for k in range(9)] + [("sizes", float(k + 1), [1.0] * (1 + k % 2)) for k in range(9)]
    rows += [("short", float(k + 1), [float(k)]) for k in range(3)] + [("pairs", float(k + 1), [float(k % 3)]) for k in range(8)]
    got = {r["k"]: r["refusal"] for r in D.decorrelation(spark.createDataFrame(rows, "k string, t double, x array<double>"), "k", "t", "x").collect()}
    assert got == {"few": "too_few_rows", "none": "too_few_rows", "still": "no_span", "nan": "not_finite", "sizes": "mixed_sizes", "short": "lag_too_short", "pairs": "no_pairs"}
    assert D.decorrelation(spark.createDataFrame([], "k string, t double, x array<double>"), "k", "t", "x").count() == 0


def test_percentiles_between_ranks(spark):
    g = np.random.default_rng(6)
    rows = [(k, float(v)) for k in range(4) for v in g.integers(0, 20, 7 + 5 * k)] + [(9, 3.0), (10, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    for f in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r["k"]: r["p"] for r in D.interpolated_percentile(df, ["k"], "v", f, "p").collect()}
        assert got == {k: pytest.approx(float(np.quantile([v for i, v in rows if i == k], f))) for k in (0, 1, 2, 3, 9)}
