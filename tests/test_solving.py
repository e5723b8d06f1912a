import math

import numpy as np
import pytest

from echofold.functions.kernels import joint_fit
from echofold.operators import solving as S

NODES = np.array([[0.0, 0, 0], [40, 5, 0], [-30, 35, 0], [10, -45, 0], [-45, -20, 0]])
FLAGS = np.array([False, False, False, True, True])
BIAS = np.array([0, 0, 0, 0.0167, -0.004])
C = 343.0


def heard(k, noise=0.0, seed=1):
    r = np.random.default_rng(seed)
    source = r.uniform(-70, 70, (k, 2))
    far = np.linalg.norm(source[:, None, :] - NODES[None, :, :2], axis=2)
    return source, r.uniform(0, 1e6, (k, 1)) + far / C + BIAS + r.normal(0, noise, far.shape)


def test_biases_are_recovered_within_three_sigma():
    inside = 0
    for seed in range(20):
        source, t = heard(12, 5e-5, seed)
        fit = joint_fit(NODES, t, FLAGS, C)
        assert fit["refusal"] is None and fit["n_equations"] == 48 and fit["n_unknowns"] == 26
        inside += bool((np.abs(fit["bias_s"] - BIAS) <= 3 * fit["sigma_s"] + 1e-12).all())
        assert np.abs(fit["bias_s"] - BIAS).max() < 5e-4 and fit["rms_s"] < 1e-4
    assert inside >= 18


def test_exact_arrivals_give_exact_answers_though_some_are_missing():
    source, t = heard(10)
    t[::3, 1] = np.nan
    t[1::4, 4] = np.nan
    fit = joint_fit(NODES, t, FLAGS, C)
    assert np.allclose(fit["bias_s"], BIAS, atol=1e-7) and np.allclose(fit["source"], source, atol=1e-3)


def test_refusals_have_names():
    _, t = heard(6)
    assert joint_fit(NODES, t, np.ones(5, bool), C)["refusal"] == "all_nodes_biased"
    under = t.copy()
    under[2, 2:] = np.nan
    assert joint_fit(NODES, under, FLAGS, C)["refusal"] == "too_few_heard"
    assert joint_fit(NODES[1:], t[:1, 1:], FLAGS[1:], C)["refusal"] == "too_few_equations"
    assert joint_fit(NODES, t[:0], FLAGS, C)["refusal"] == "too_few_heard"
    # Events that are one event say as little as one.
    again = np.repeat(t[:1], 6, axis=0)
    assert joint_fit(NODES[:4], again[:, :4], FLAGS[:4], C)["refusal"] in ("rank_deficient", None)


def test_a_fleet_without_biases():
    source, t = heard(3)
    fit = joint_fit(NODES, t - BIAS, np.zeros(5, bool), C)
    assert fit["refusal"] is None and not fit["bias_s"].any() and np.allclose(fit["source"], source, atol=1e-3)


def test_sets_are_fitted_apart(spark):
    rows = []
    for name, k, flags in (("a", 8, FLAGS), ("b", 5, FLAGS), ("c", 4, np.ones(5, bool))):
        _, t = heard(k, seed=k)
        rows += [(name, e, n, float(t[e, n]), bool(flags[n])) for e in range(k) for n in range(5)]
    rows += [rows[0], ("a", 0, 99, 1.0, False), ("a", 1, 0, None, False)]
    survey = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(NODES)], "node int, x double, y double, z double")
    got = S.joint_calibration(spark.createDataFrame(rows, "set string, event int, node int, t double, biased boolean"), survey, C).collect()
    sets = {r["set"]: r for r in got if r["kind"] == "set"}
    assert {k: (r["n_events"], r["refusal"]) for k, r in sets.items()} == {"a": (8, None), "b": (5, None), "c": (4, "all_nodes_biased")}
    for name in "ab":
        assert {int(r["id"]): round(r["bias_s"], 6) + 0.0 for r in got if r["set"] == name and r["kind"] == "node"} == {n: b for n, b in enumerate(BIAS)}
    assert not [r for r in got if r["set"] == "c" and r["kind"] != "set"]


def test_an_empty_table_of_arrivals(spark):
    survey = spark.createDataFrame([], "node int, x double, y double, z double")
    assert S.joint_calibration(spark.createDataFrame([], "set string, event int, node int, t double, biased boolean"), survey, C).count() == 0
    assert S.cone_fits(spark.createDataFrame([], "event int, node int, t double, v double"), survey, "v", C).count() == 0


def test_shock_fronts_are_refused_by_name(spark):
    survey = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(NODES)], "node int, x double, y double, z double")
    b, d, v = math.radians(30.25), 4.5, 700.0
    slope = math.sqrt(1 / C**2 - 1 / v**2)
    along = NODES[:, 0] * math.sin(b) + NODES[:, 1] * math.cos(b)
    across = NODES[:, 0] * math.cos(b) - NODES[:, 1] * math.sin(b)
    t = 5.0 + along / v + np.abs(across - d) * slope
    rows = [(1, n, float(t[n]), v) for n in range(5)] + [(2, n, float(t[n]), 300.0) for n in range(5)] + [(3, n, float(t[n]), v) for n in range(3)] + [(1, 0, None, v)]
    got = {r["event"]: r for r in S.cone_fits(spark.createDataFrame(rows, "event int, node int, t double, v double"), survey, "v", C).collect()}
    assert (got[1]["bearing_deg"], got[1]["offset_m"]) == (pytest.approx(30.25), pytest.approx(4.5)) and got[1]["rms_s"] < 1e-9
    assert [got[k]["refusal"] for k in (1, 2, 3)] == [None, "subsonic", "too_few_arrivals"]
