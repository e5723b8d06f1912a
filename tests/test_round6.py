"""Fits that must find what was planted where arrivals leave little to go by."""

import math

import numpy as np

from echofold.functions import kernels


def test_a_path_with_all_nodes_on_one_side_takes_its_offset_from_the_time_it_passes():
    """Supplier 968: its front is that of any path further off. Without a time there is no offset, and no digit of noise chooses one."""
    p = np.array([(0.0, 0.0), (40.0, 5.0), (-30.0, 35.0), (-45.0, -20.0), (35.0, 40.0)])
    slope = math.sqrt(1 / 343.0**2 - 1 / 700.0**2)
    for bearing, offset in ((254.0, -8.0), (254.0, -31.25), (30.0, 58.5), (254.0, 3.0)):
        b = math.radians(bearing)
        across = p @ [math.cos(b), -math.sin(b)]
        t = 968.0 + p @ [math.sin(b), math.cos(b)] / 700.0 + np.abs(across - offset) * slope
        at = p[:, 0], p[:, 1], np.zeros(len(p))
        known = kernels.mach_cone(np.stack(at, axis=1), t - t.min(), 700.0, 343.0, passed=968.0 - t.min())
        alone = kernels.mach_cone(np.stack(at, axis=1), t - t.min(), 700.0, 343.0)
        one_side = (across > offset).all() or (across < offset).all()
        assert known[:2] == (bearing, offset) and alone[:2] == (bearing, None if one_side else offset)


def calibrated(cust, orders, biased=(4, 5)):
    """What six nodes hear of a customer's orders, two of them with an offset of their own; as ``joint_calibration`` of the plans has it."""
    nodes = np.array([(0.0, 0.0, 0.0), (40.0, 5.0, 0.0), (-30.0, 35.0, 0.0), (10.0, -45.0, 0.0), (-45.0, -20.0, 0.0), (35.0, 40.0, 0.0)])
    bias = np.array([0, 0, 0, 0, cust * 37 % 400 - 200, cust * 53 % 300 - 150]) / 10000
    o, n = np.array(sorted(orders))[:, None], np.arange(1, 7)[None]
    source = np.concatenate([o * 17 % 160 - 80.0, o * 29 % 140 - 70.0], axis=1)
    t = o * 10.0 + np.linalg.norm(nodes[None, :, :2] - source[:, None], axis=2) / 343.0 + bias
    return nodes, np.where((o + n * 3) % 5 != 0, t, np.nan), bias, source


#: Sources from which one descent puts an event beside a node, where it stays: (-63, -21) went to (-44, -20).
HELD = [(-56, -22), (58, -24), (-72, -14), (-1, 33), (59, 53), (-69, -43), (-44, -18), (-63, -21), (-46, -32), (45, -45), (-47, 51)]
HELD_BY = [4, 5, 5, 4, 4, 5, 5, 5, 4, 5, 5]


def _order(source, n):
    """An order whose source this is, heard by so many nodes."""
    return next(o for o in range(10**6) if (o * 17 % 160 - 80, o * 29 % 140 - 70) == source and sum((o + k * 3) % 5 != 0 for k in range(1, 7)) == n)


def test_an_event_in_a_wrong_place_does_not_hold_the_biases():
    nodes, t, bias, source = calibrated(9859, [_order(s, n) for s, n in zip(HELD, HELD_BY)])
    fit = kernels.joint_fit(nodes, t, [False] * 4 + [True] * 2, 343.0)
    assert np.allclose(fit["bias_s"], bias, atol=1e-7) and np.allclose(fit["source"], source, atol=1e-3)


def test_many_sets_at_once_are_fitted_as_each_alone():
    """Sets of unlike nodes, some refused, one with noise."""
    r, sets = np.random.default_rng(3), []
    for cust, k in ((7, 8), (12, 6), (31, 9), (5, 1), (9, 7)):
        nodes, t, _, _ = calibrated(cust, r.choice(10000, k, replace=False))
        if cust == 31:
            t = t + r.normal(0, 1e-4, t.shape)
        if cust == 9:
            t[:, 5] = np.nan
        flags = np.array([False] * 4 + [True] * 2) if cust != 12 else np.ones(6, bool)
        sets.append((nodes, t, flags))
    p = np.stack([np.where(np.isfinite(t).any(axis=0)[:, None], nodes, np.nan) for nodes, t, _ in sets])
    real = np.isfinite(p[:, :, 0])
    count = [len(t) for _, t, _ in sets]
    got = kernels.joint_fits(p, np.concatenate([t for _, t, _ in sets]), np.stack([f for _, _, f in sets]) & real, count, 343.0)
    for k, ((nodes, t, flags), mine) in enumerate(zip(sets, real)):
        want = kernels.joint_fit(nodes[mine], t[:, mine], flags[mine], 343.0)
        assert got["refusal"][k] == want["refusal"] and bool(got["fitted"][k]) == (want["bias_s"] is not None)
        if want["bias_s"] is not None:
            assert np.allclose(got["bias_s"][k][mine], want["bias_s"], atol=1e-8) and np.isclose(got["rms_s"][k], want["rms_s"], atol=1e-10)
    assert got["refusal"].tolist() == [None, "all_nodes_biased", None, None, None]


def passing(s, heard):
    """Points (receiver, t, hz) of supplier ``s`` as ``passing_sources`` of the plans has them."""
    from echofold.operators import ridges as G

    return [(k, t, float(G.doppler_hz(t, 100.0 + s % 50, 10.0 + s % 20, 8.0 + s % 5, 5.0 + s % 12, 15.0 * k, 343.0))) for k, t in heard]


def test_a_near_miss_of_a_doppler_curve_is_not_taken_for_it(spark):
    """Eight points that another curve, 146.00 Hz and backwards, nearly fits."""
    from echofold.operators import ridges as G

    heard = [(1, 18.0), (2, 4.1), (1, 19.7), (2, 12.0), (1, 18.2), (1, 15.6), (1, 15.9), (1, 15.6)]
    rows = [(10596, *x) for x in passing(10596, heard)]
    receivers = spark.createDataFrame([(k, 15.0 * k) for k in range(3)], "receiver int, x_m double")
    (fit,) = G.doppler_fits(spark.createDataFrame(rows, "set long, receiver int, t double, hz double"), receivers).collect()
    assert [round(fit[c], 3) for c in ("f0_hz", "v_mps", "t_cpa_s", "d_m")] == [146.0, 26.0, 9.0, 5.0] and fit["rms_hz"] < 1e-7


def test_passings_are_fitted_in_lots_that_hold_whole_sets(spark, monkeypatch):
    """Many sets in a task, more than a batch holds, one with noise and some of too few points."""
    from echofold.operators import ridges as G

    r, rows = np.random.default_rng(8), []
    for s in range(60):
        n = 5 if s % 10 == 3 else int(r.integers(30, 90))
        rows += [(f"s{s}", k, t, hz + (r.normal(0, 0.02) if s == 7 else 0.0)) for k, t, hz in passing(s, [(int(r.integers(0, 3)), float(r.integers(0, 200)) / 10) for _ in range(n)])]
    receivers = spark.createDataFrame([(k, 15.0 * k) for k in range(3)], "receiver int, x_m double")
    points = spark.createDataFrame(rows + [(None, *x) for x in passing(4, [(k % 3, k * 0.7) for k in range(20)])], "set string, receiver int, t double, hz double")
    whole = {x["set"]: x for x in G.doppler_fits(points, receivers).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {x["set"]: x for x in G.doppler_fits(points, receivers).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 61 and {k: (x["n"], x["refusal"]) for k, x in got.items()} == {k: (x["n"], x["refusal"]) for k, x in whole.items()}
    for name, x in got.items():
        s = 4 if name is None else int(name[1:])
        if name is not None and s % 10 == 3:
            assert (x["n"], x["refusal"], x["f0_hz"]) == (5, "too_few_points", None)
        elif s != 7:
            assert [round(x[c], 3) for c in ("f0_hz", "v_mps", "t_cpa_s", "d_m")] == [100.0 + s % 50, 10.0 + s % 20, 8.0 + s % 5, 5.0 + s % 12]
    assert abs(got["s7"]["v_mps"] - 17.0) < 0.5 and 0.005 < got["s7"]["rms_hz"] < 0.04


def test_small_lots_give_the_same_fits(monkeypatch):
    from echofold.operators import ridges as G

    r, t, hz, x, count = np.random.default_rng(2), [], [], [], []
    for s in range(25):
        n = int(r.integers(8, 60))
        points = passing(s, [(int(r.integers(0, 3)), float(r.integers(1, 200)) / 10) for _ in range(n - 1)] + [(0, 0.0)])
        count.append(n)
        for a, b in ((t, 1), (hz, 2)):
            a += [q[b] for q in points]
        x += [15.0 * q[0] for q in points]
    at = [np.array(v) for v in (t, hz, x)]
    want = G.passing_fits(*at, count, 343.0, 1.0)[1]
    monkeypatch.setattr(G, "FIT_POINTS", 100)
    assert np.allclose(G.passing_fits(*at, count, 343.0, 1.0)[1], want, atol=1e-6)


def test_many_point_fits_at_once_are_those_of_each_alone():
    """Whole events and each without one arrival, with three unknowns and two."""
    r = np.random.default_rng(5)
    for n, fixed_up in ((3, None), (4, None), (6, None), (25, None), (80, None), (3, 10.0), (7, 10.0)):
        p = r.uniform(0, 4000, (6, n, 3)) * [1, 1, 0.1]
        t = 1e6 + np.linalg.norm(p - r.uniform(500, 3500, (6, 1, 3)) * [1, 1, 0.1], axis=2) / 343.0
        event, left, at, rms, dop, refusal = kernels.point_sources(p, t, 343.0, True, fixed_up=fixed_up)
        assert len(event) == 6 * (n + 1)
        for k in r.choice(len(event), min(12, len(event)), replace=False):
            kept = np.arange(n) != left[k]
            want = kernels.point_source(p[event[k]][kept], t[event[k]][kept] - 1e6, 343.0, fixed_up=fixed_up)
            assert refusal[k] == want[-1] and (want[0] is None) == bool(np.isnan(rms[k]))
            # Where there are as many arrivals as unknowns, another place may fit as well.
            if want[0] is not None and kept.sum() > 6:
                assert np.allclose(at[k][:2], want[:2], atol=1e-3) and abs(rms[k] - want[3]) < 1e-9 and abs(dop[k] - want[4]) < 1e-5


def test_leaving_arrivals_out_is_one_call_for_many_events(spark, monkeypatch):
    """The single fit, a Python call for each node of an event, isn't asked; events with a node twice still come out."""
    from echofold.operators.association import solve_events

    places = [(0.0, 0.0, 0.0), (900.0, 100.0, 10.0), (200.0, 800.0, 20.0), (700.0, 900.0, 5.0), (400.0, 300.0, 15.0), (850.0, 500.0, 0.0)]
    heard = [(n, *p, math.dist(p, (333.0, 444.0, 8.0)) / 343.0) for n, p in enumerate(places)]
    kind = "event_key string, arrivals array<struct<node: long, x: double, y: double, z: double, t: double>>"
    once = solve_events(spark.createDataFrame([(f"e{k}", heard[: 6 - k]) for k in range(4)], kind), 343.0, leave_one_out=True)
    twice = solve_events(spark.createDataFrame([("d", [*heard, (0, *places[0], 1.0)])], kind), 343.0, leave_one_out=True)
    got = {(x["event_key"], x["left_out"]): x for x in once.collect()}
    assert set(got) == {(f"e{k}", o) for k in range(4) for o in [None, *map(str, range(6 - k))]}
    assert got["e0", None]["refusal"] is None and abs(got["e0", "3"]["e_m"] - 333.0) < 1e-2 and got["e0", "3"]["dof"] == 1
    assert [got["e2", o]["refusal"] for o in "0123"] == ["too_few_arrivals"] * 4 and got["e2", "0"]["dof"] == -1 and got["e2", "0"]["e_m"] is None
    assert len(twice.collect()) == 8


def test_rows_are_not_shuffled_for_each_few_thousand_nodes(spark):
    """Forty thousand nodes in eight blocks, so that a row is shuffled for eight others; blocks of 4096 would be ten, and 132 for the nodes of the largest tables."""
    from echofold.operators import temporal as W

    df = spark.range(80000).selectExpr("id % 40000 AS node", "CAST(id / 3 AS BIGINT) * 10 + id % 3 AS t")
    out = W.pair_cooccurrence(df, "t", "node", 10)
    assert out.rdd.getNumPartitions() == 36
    assert [tuple(r) for r in out.groupBy("n_bins").count().orderBy("n_bins").collect()] == [tuple(r) for r in _shared(df).groupBy("n_bins").count().orderBy("n_bins").collect()]


def _shared(df):
    from pyspark.sql import functions as F

    one = df.select("node", F.floor(F.col("t") / 10).alias("bin")).distinct()
    return one.alias("x").join(one.alias("y"), "bin").where("x.node < y.node").groupBy("x.node", "y.node").agg(F.count("*").alias("n_bins"))


def test_a_draw_is_given_in_frames_of_bounded_size(spark, monkeypatch):
    """What a slice's draws change comes in several frames, and the census is the same whatever their size."""
    from echofold.operators import association as S

    r = np.random.default_rng(11)
    rows = [(int(n), k, float(t)) for k, (n, t) in enumerate(zip(r.integers(0, 25, 700), np.sort(r.uniform(0, 60, 700))))]
    survey = spark.createDataFrame([(n, n % 5 * 30.0, n % 3 * 40.0, 0.0) for n in range(25)], "node long, x double, y double, z double")
    dets = spark.createDataFrame(rows, "node long, seq long, t double")
    find = lambda: sorted(tuple(x) for x in S.pair_census_null(dets, survey, 3, 20, 5, 340.0, 0.3, 1.0).collect())
    want, solves = find(), []
    grouped = type(dets.groupBy("node"))
    apply = grouped.applyInPandas
    monkeypatch.setattr(grouped, "applyInPandas", lambda self, f, schema: solves.append(f) or apply(self, f, schema))
    assert find() == want and solves
    import pandas as pd

    fresh = [(0, d, -1 - d, 3, 9000 + d, 5.0 + d * 2.1, 90.0, 0.0, 0.0, -1, 1, True) for d in range(20)]
    known = [(0, 0, k, n, k, t, n % 5 * 30.0, n % 3 * 40.0, 0.0, k, 0, True) for n, k, t in rows if n != 3]
    frame = pd.DataFrame(known + fresh, columns=["slice", "draw", "row", "node", "seq", "t", "x", "y", "z", "seed", "kind", "own"])
    monkeypatch.setattr(S, "DRAW_PAIRS", 40)
    sizes = [len(x) for x in solves[0](iter([frame]))]
    assert len(sizes) > 3 and max(sizes) < 400
