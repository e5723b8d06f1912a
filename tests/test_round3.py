"""Findings of the third review, each with what failed before."""

import itertools
import random
import re
from collections import Counter
from decimal import Decimal

import pytest


@pytest.mark.parametrize("name", [int, "n{}".format])
def test_pairs_of_a_bin_are_counted_without_a_join_of_its_nodes(spark, name):
    from echofold.operators import temporal as W

    random.seed(3)
    rows = [(name(random.randrange(90)), random.randrange(4000)) for _ in range(900)]
    out = W.pair_cooccurrence(spark.createDataFrame(rows, ["node", "t"]), "t", "node", 100, block=7)
    bins = {}
    for n, t in rows:
        bins.setdefault(t // 100, set()).add(n)
    want = Counter(p for b in bins.values() for p in itertools.combinations(sorted(b), 2))
    got = out.collect()
    assert len(got) == len(want) and {(r["node_a"], r["node_b"]): r["n_bins"] for r in got} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_joint_fit_takes_one_descent_where_the_first_is_exact(monkeypatch):
    import numpy as np

    from echofold.functions import kernels

    p = np.array([(0.0, 0.0, 0.0), (40.0, 5.0, 0.0), (-30.0, 35.0, 0.0), (10.0, -45.0, 0.0), (-45.0, -20.0, 0.0), (35.0, 40.0, 0.0)])
    src = np.array([(x * 17 % 160 - 80, x * 29 % 140 - 70) for x in range(1, 30, 3)], float)
    t = np.linalg.norm(p[None, :, :2] - src[:, None], axis=2) / 343.0
    t[:, 4] += 0.0123
    calls, real = [], kernels._Joint.descend
    monkeypatch.setattr(kernels._Joint, "descend", lambda self, b: calls.append(1) or real(self, b))
    fit = kernels.joint_fit(p, t, [False] * 4 + [True, False], 343.0)
    assert fit["bias_s"][4] == pytest.approx(0.0123, abs=1e-7) and len(calls) == 1


def test_a_cone_is_the_best_of_the_whole_grid_without_all_its_points(monkeypatch):
    import numpy as np

    from echofold.functions import kernels

    rng, v, c = np.random.default_rng(5), 700.0, 343.0
    slope = np.sqrt(1 / c**2 - 1 / v**2)
    offsets = np.arange(-60.0, 60.25, 0.25)
    for _ in range(3):
        p = np.column_stack([rng.uniform(-50, 50, (5, 2)), np.zeros(5)])
        t = rng.uniform(0, 0.1, 5)
        whole = []
        for b in np.arange(0.0, 360.0, 0.25):
            along = np.array([np.sin(np.radians(b)), np.cos(np.radians(b))])
            r = t - (p[:, :2] @ along)[None] / v - np.abs((p[:, :2] @ [along[1], -along[0]])[None] - offsets[:, None]) * slope
            whole.append(r.std(axis=1))
        i, j = np.unravel_index(np.argmin(whole), (1440, 481))
        asked, real = [], np.abs
        monkeypatch.setattr(np, "abs", lambda x, *a, **k: asked.append(np.size(x)) or real(x, *a, **k))
        bearing, offset, rms = kernels.mach_cone(p, t, v, c)
        monkeypatch.undo()
        assert (bearing, offset) == (i * 0.25, offsets[j]) and rms == pytest.approx(whole[i][j], abs=1e-12)
        assert sum(asked) < 1440 * 481 * 5 / 4


#: Receiver and time of nine points of a passing that three starting places missed.
_POINTS = [(1, 2.2), (1, 6.1), (1, 8.6), (2, 10.6), (2, 13.0), (2, 15.1), (0, 15.6), (1, 15.8), (1, 18.4)]


def test_rounding_of_vectors_agrees_with_sql_to_the_sign_of_nothing(spark):
    import duckdb
    from pyspark.sql import functions as F

    from echofold.functions import acoustics as A

    values = [-3e-6, 3e-6, 0.0, 1.2345649999, -1.5e-5, -2.5e-7, 123.4567895]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (5, 6):
        got = [r[0] for r in df.select(A.rounded(F.col("x"), digits)).collect()]
        assert list(map(repr, got)) == [repr(duckdb.sql(f"SELECT round(CAST('{v!r}' AS DOUBLE), {digits})").fetchall()[0][0]) for v in values]


@pytest.mark.parametrize("name", ["frame_codec", "sketch_corpus"])
def test_nodes_beyond_16_bits_keep_their_numbers(spark, tmp_path, name):
    import duckdb

    from echofold import plans

    duckdb.sql(f"COPY (SELECT CAST(range AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 977 MINUTE * range AS ts, CAST(range * 9000 % 140000 AS BIGINT) AS user_id, 'view' AS event_type, 1.5 AS value, '' AS props FROM range(100)) TO '{tmp_path}/events.parquet'")
    df, con = plans.QUERIES[name](spark, str(tmp_path)), duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, Decimal) else v for v in r)) for r in rows)
    assert plain(df.collect()) == plain(want)


def test_a_doppler_fit_of_few_points_finds_the_exact_curve(spark):
    from echofold.operators import ridges as G

    rows = [(1, r, t, float(G.doppler_hz(t, 110.0, 20.0, 8.0, 11.0, r * 15.0, 343.0))) for r, t in ((r, float(t)) for r, t in _POINTS)]
    fit = G.doppler_fits(spark.createDataFrame(rows, "set long, receiver int, t double, hz double"), spark.createDataFrame([(k, 15.0 * k) for k in range(3)], "receiver int, x_m double")).collect()[0]
    assert [round(fit[c], 3) for c in ("f0_hz", "v_mps", "t_cpa_s", "d_m")] == [110.0, 20.0, 8.0, 11.0]


@pytest.mark.parametrize("name", ["repeats_within_window", "one_use_nearest", "pair_coincidences"])
def test_no_small_group_is_a_call_of_its_own(spark, name):
    from echofold import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_payloads_of_a_tenant_are_dealt_over_tasks(spark):
    from echofold import plans

    plan = plans.QUERIES["payloads_that_differ"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\([^,]+, [^,]+, \d+\)", re.sub(r"knownproduced\([^)]*\)", "", plan))


def test_many_ranges_share_tasks_and_give_every_line_once(spark, tmp_path):
    from echofold.sources import ranges as R

    (tmp_path / "a.jsonl").write_text("".join(f'{{"i": {k}}}\n' for k in range(5000)))
    lines = R.frozen_lines(spark, str(tmp_path), 64)
    assert lines.rdd.getNumPartitions() <= R.MOST_TASKS
    got = sorted(r["line"] for r in lines.select("line").collect())
    assert got == sorted(f'{{"i": {k}}}' for k in range(5000))
