import numpy as np
import pytest

from echofold.operators import ridges as G

FS, C = 4000.0, 343.0
TRUE = (440.0, 18.0, 4.0, 12.0)
RECEIVERS = {0: 0.0, 1: 25.0}


def passing(x, seconds=8.0, noise=0.01, seed=1):
    """What a receiver hears of a tone and its second harmonic that pass by."""
    t = np.arange(int(seconds * FS)) / FS
    hz = G.doppler_hz(t, *TRUE, x, C)
    phase = 2 * np.pi * np.cumsum(hz) / FS
    g = np.random.default_rng(seed)
    return np.sin(phase) + 0.3 * np.sin(2 * phase) + noise * g.normal(size=len(t)), hz


def test_ridges_follow_a_passing_tone(spark):
    rows = [("p", r, 100.0, FS, passing(x)[0].tolist()) for r, x in RECEIVERS.items()] + [("p", 2, 0.0, FS, [0.0] * 100), ("p", 3, 0.0, FS, None)]
    clips = spark.createDataFrame(rows, "set string, receiver int, start_s double, fs double, samples array<double>")
    points = G.ridges(clips, size=1024, hop=256, low=200.0, high=1200.0, most=2)
    got = points.toPandas()
    assert set(got["receiver"]) == {0, 1} and set(got["track"]) == {0, 1}
    for r, x in RECEIVERS.items():
        one = got[(got["receiver"] == r) & (got["track"] == 0)].sort_values("t")
        want = np.interp(one["t"] - 100.0, np.arange(int(8 * FS)) / FS, passing(x)[1])
        assert len(one) > 100 and np.abs(one["hz"] - want).iloc[1:].max() < 3.0
    receivers = spark.createDataFrame(list(RECEIVERS.items()), "receiver int, x_m double")
    (fit,) = G.doppler_fits(points.where("track = 0"), receivers, C).collect()
    assert fit["refusal"] is None and fit["rms_hz"] < 3.0
    assert [fit[k] for k in ("f0_hz", "v_mps", "t_cpa_s", "d_m")] == [pytest.approx(440.0, abs=1), pytest.approx(18.0, abs=1), pytest.approx(104.0, abs=0.1), pytest.approx(12.0, abs=2)]


def test_bad_windows_are_refused(spark):
    clips = spark.createDataFrame([], "set string, receiver int, start_s double, fs double, samples array<double>")
    assert G.ridges(clips).count() == 0
    for size, hop in ((1000, 10), (16, 4), (64, 65), (64, 0)):
        with pytest.raises(ValueError):
            G.ridges(clips, size=size, hop=hop)


def test_outliers_hardly_move_a_fit(spark):
    g = np.random.default_rng(5)
    rows = []
    for name, p in (("there", TRUE), ("back", (200.0, -25.0, 6.0, 8.0))):
        for k in range(120):
            t, r = k / 12, k % 2
            hz = float(G.doppler_hz(t, *p, RECEIVERS[r], C) + g.normal(0, 0.05) + (60.0 if k % 11 == 0 else 0.0))
            rows.append((name, r, t, hz))
    rows += [("few", 0, float(k), 100.0) for k in range(7)] + [("there", 9, 1.0, 5.0), ("there", 0, None, 5.0), ("there", 0, 1.0, None)]
    receivers = spark.createDataFrame(list(RECEIVERS.items()), "receiver int, x_m double")
    got = {r["set"]: r for r in G.doppler_fits(spark.createDataFrame(rows, "set string, receiver int, t double, hz double"), receivers, C).collect()}
    assert got["few"]["refusal"] == "too_few_points" and got["there"]["n"] == 120
    assert [got["there"][k] for k in ("f0_hz", "v_mps", "t_cpa_s", "d_m")] == [pytest.approx(v, rel=0.06) for v in TRUE]
    assert [got["back"][k] for k in ("f0_hz", "v_mps", "t_cpa_s", "d_m")] == [pytest.approx(v, rel=0.06) for v in (200.0, -25.0, 6.0, 8.0)]


def test_layers_from_noisy_delays(spark):
    g = np.random.default_rng(3)
    rows = [("road", hz, d, float(0.2 + d / G.layered_velocity(hz, 0.12, 180.0) * (1 + g.normal(0, 1e-4)))) for hz in np.geomspace(10, 400, 20).tolist() for d in (2.0, 4.0, 7.0, 11.0)]
    rows += [("road", 5.0, 2.0, 0.3), ("road", 5.0, 2.0, 0.4), ("road", 6.0, 2.0, 0.3), ("road", 6.0, 3.0, 0.2), ("road", 7.0, 2.0, 0.5), ("road", 7.0, 3.0, 0.4), ("road", 7.0, 4.0, 0.3), ("road", None, 1.0, 1.0), ("one", 9.0, 1.0, 0.1), ("one", 9.0, 2.0, 0.2), ("one", 9.0, 3.0, 0.3)]
    speeds = G.phase_velocities(spark.createDataFrame(rows, "set string, hz double, distance_m double, delay_s double"))
    found = {(r["set"], r["hz"]): r for r in speeds.collect()}
    assert [found["road", hz]["refusal"] for hz in (5.0, 6.0, 7.0)] == ["no_aperture", "too_few_stations", "backwards"]
    assert found["one", 9.0]["velocity_mps"] == pytest.approx(10.0)
    fits = {r["set"]: r for r in G.layer_fits(speeds).collect()}
    assert fits["one"]["refusal"] == "too_few_picks"
    road = fits["road"]
    assert (road["n"], road["refusal"]) == (20, None) and road["h_m"] == pytest.approx(0.12, rel=0.03) and road["shear_mps"] == pytest.approx(180.0, rel=0.02)
    assert road["modulus_pa"] == pytest.approx(1800.0 * road["shear_mps"] ** 2)
