"""Counting and copies whose tasks are even and whose loops are short."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.functions import kernels
from echofold.operators import association as S
from echofold.operators import decorrelation as D
from echofold.operators import matching as M
from tests.test_bounded_pairs import plan_of


def test_each_pair_of_blocks_is_a_task_of_its_own(spark):
    """Dealt by hash, some tasks would get several pairs of blocks and others none."""
    df = spark.createDataFrame([(k % 97, k) for k in range(3000)], "node long, t long")
    counted = M.pair_counts(df, 50)
    assert counted.rdd.getNumPartitions() == 36
    assert counted.groupBy(F.spark_partition_id()).count().count() == 36


def test_a_census_takes_events_of_equal_members_for_several(spark):
    """The same nodes and numbers come again beyond the window: two events, whose keys are equal."""
    survey = spark.createDataFrame([(n, 0.0, 0.0, 0.0) for n in (1, 2)], "node long, x double, y double, z double")
    rows = [(1, 7, 0.0), (2, 7, 0.01), (1, 7, 5.0), (2, 7, 5.01)]
    got = S.pair_census(spark.createDataFrame(rows, "node long, seq long, t double"), survey, 340.0, 0.03, 0.2).collect()
    assert [(x["a"], x["b"], x["n"]) for x in got] == [(1, 2, 2)]


def test_only_copies_within_the_window_are_looped_over(spark):
    rows = [(1, None), (1, 0.0), (1, 9.0), (2, 0.0), (2, 5.0), (2, 5.1), (2, 5.25), (2, 9.0), (3, float("-inf")), (3, 1.0), (3, float("inf")), (3, float("inf")), (4, 1.0), (4, float("nan")), (5, 1.0)]
    out = S.first_copies(spark.createDataFrame(rows, "k long, t double"), ["k"], "t", 0.2)
    got = [(x["k"], "None" if x["t"] != x["t"] else str(x["t"]), x["accepted"]) for x in out.collect()]
    want = [(1, "None", True), (1, "0.0", False), (1, "9.0", False), (2, "0.0", True), (2, "5.0", True), (2, "5.1", False), (2, "5.25", True), (2, "9.0", True), (3, "-inf", True), (3, "1.0", True), (3, "inf", True), (3, "inf", False), (4, "1.0", True), (4, "None", False), (5, "1.0", True)]
    assert sorted(got) == sorted(want)
    assert "Union" in plan_of(out)


def test_far_heads_are_decided_together():
    """As a loop over all members would."""
    r = np.random.default_rng(4)
    for margin in (-0.5, 0.0, 0.7, 2.0, 6.0):
        for _ in range(60):
            n = int(r.integers(2, 60))
            t = np.sort(r.integers(0, 80, n) / 8)
            place = r.integers(0, 9, (n, 3)) * 1.0
            if t[-1] - t[0] <= margin:
                continue
            want = [0]
            for j in range(1, n):
                if not any(t[j] - t[k] > math.dist(place[j], place[k]) / 2 + margin for k in want):
                    want.append(j)
            assert kernels._reachable(t, place, 0, np.arange(1, n), 2.0, margin).tolist() == want[1:]


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_lagged_pairs_by_blocks_equal_all_pairs(spark, block_rows):
    """A row is dealt to blocks that lags lead it to, not once for each lag."""
    r = random.Random(block_rows)
    series, ks = {11: 40, 12: 9}, {11: [1, 2, 3, 5, 9], 12: [1, 2]}
    rows = []
    for s, n in series.items():
        t = sorted(r.sample(range(4 * n), n))
        for i in range(n):
            z = [0.0, 0.0, 0.0] if i == 4 else [r.uniform(-1, 1) for _ in range(3)]
            rows.append((s, i, float(t[i]), z, math.sqrt(sum(x * x for x in z)), r.uniform(-1, 1)))
    want = {}
    for s, i, t, z, norm, lev in rows:
        for s2, i2, t2, z2, norm2, lev2 in rows:
            k = i2 - i
            if s == s2 and k in ks[s] and norm > 0 and norm2 > 0 and 0.5 * k * 4.0 <= t2 - t <= 1.5 * k * 4.0:
                n, cos, ll = want.get((s, k, t2 - t), (0, 0.0, 0.0))
                want[s, k, t2 - t] = (n + 1, cos + sum(x * y for x, y in zip(z, z2)) / (norm * norm2), ll + lev * lev2)
    r.shuffle(rows)
    z = spark.createDataFrame(rows, "s long, i long, t double, z array<double>, norm double, lev double")
    asked = spark.createDataFrame([(s, n, 4.0, ks[s], block_rows) for s, n in series.items()], "s long, n long, dt double, ks array<int>, block long")
    got = {}
    for x in D._by_separation(z, asked).collect():
        n, cos, ll = got.get((x["s"], x["k"], x["sep"]), (0, 0.0, 0.0))
        got[x["s"], x["k"], x["sep"]] = (n + x["n"], cos + x["cos"], ll + x["ll"])
    assert len(got) > 30 and got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and got[key][1:] == pytest.approx(want[key][1:]) for key in want)


def test_decorrelation_shuffles_no_row_for_each_lag(spark, monkeypatch):
    """All 48 lags of a series that is one block lead to this block."""
    rows = [(1, 10.0 * i + 10, [math.sin(i / 9), math.cos(i / 5)]) for i in range(600)]
    df, plans_seen = spark.createDataFrame(rows, "k long, t double, v array<double>"), []
    monkeypatch.setattr(D, "written", lambda x, *by, real=D.written: plans_seen.append(x._jdf.queryExecution().optimizedPlan().toString()) or real(x, *by))
    whole = D.decorrelation(df, "k", "t", "v").collect()
    assert any("MapInArrow" in p for p in plans_seen) and not any("za" in p for p in plans_seen)
    monkeypatch.setattr(D, "BLOCK_ROWS", 50)
    cut = D.decorrelation(df, "k", "t", "v").collect()
    assert [x["lag_rows"] for x in whole] == [x["lag_rows"] for x in cut] and whole[0]["refusal"] is None
    assert [(x["n_pairs"], x["lag_s"], x["channel"]) for x in whole] == [(x["n_pairs"], x["lag_s"], x["channel"]) for x in cut]
    assert cut[0]["statistic"] == pytest.approx(whole[0]["statistic"], rel=1e-9)
