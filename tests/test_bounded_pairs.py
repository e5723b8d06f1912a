import os
import random

import numpy as np
import pytest

from echofold import plans
from echofold.functions import kernels
from echofold.operators import association as S
from echofold.operators import matching as M

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vetoed_suspects_equal_all_pairs(spark):
    r = random.Random(5)
    rows = [(k, r.randint(1, 6), r.randint(-40, 260), r.choice(["view", "purchase", "other"])) for k in range(150)] + [(900, None, 3, "view"), (901, 2, None, "purchase")]
    shifts, tolerance, near = [-60, -30, 30, 60], 9, 7
    want = {}
    for l_id, l_node, l_t, _ in (x for x in rows if x[3] == "view" and None not in x):
        fits = [
            (abs(l_t + s - r_t), abs(s), s, r_id)
            for r_id, r_node, r_t, kind in rows
            for s in shifts
            if kind == "purchase" and None not in (r_node, r_t) and r_node != l_node and abs(l_t + s - r_t) <= tolerance and not any(n == r_node and t is not None and abs(t - l_t) <= near for _, n, t, _ in rows)
        ]
        if fits:
            want[l_id] = (min(fits)[3], min(fits)[2], min(fits)[0])
    df = spark.createDataFrame(rows, "seq long, node long, t long, source string")
    left = df.where("source = 'view'").selectExpr("seq AS l_id", "node AS l_node", "t AS l_t")
    right = df.where("source = 'purchase'").selectExpr("seq AS r_id", "node AS r_node", "t AS r_t")
    got = M.vetoed_suspects(left, right, df.select("node", "t"), shifts, tolerance, near).collect()
    assert len(want) > 20 and {x["l_id"]: (x["r_id"], x["shift"], x["error"]) for x in got} == want and len(got) == len(want)


def test_whole_shift_suspects_makes_no_pairs(spark):
    assert "Join" not in plan_of(plans.QUERIES["whole_shift_suspects"](spark, SF))


@pytest.mark.parametrize(("n", "nodes", "block_rows", "cells"), [(0, 1, 50, 4), (1, 1, 50, 4), (300, 25, 10, 4), (300, 2, 1000, 1 << 20)])
def test_pair_counts_equal_all_pairs(spark, monkeypatch, n, nodes, block_rows, cells):
    r = random.Random(n + nodes)
    rows = [(r.randint(-3, nodes), r.randint(-50, 400)) for _ in range(n)]
    want = {}
    for a, t in rows:
        for b, u in rows:
            if a < b and abs(t - u) <= 7:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame([*rows, (None, 3), (4, None)], "node long, t long")
    got = M.pair_counts(df, 7, block_rows).collect()
    assert {(x["node_a"], x["node_b"]): x["n"] for x in got} == want and len(got) == len(want)
    monkeypatch.setattr(M, "TABLE_CELLS", cells)
    side = [np.array([[a for a, _ in rows], [t for _, t in rows]], np.int64)]
    found = [row for batch in M._cell_counts(side if n else [], [], (0, 0), 7) for row in batch.to_pylist()]
    assert {(x["node_a"], x["node_b"]): x["n"] for x in found} == want


def test_band_join_counts_shuffles_no_pairs(spark):
    assert "Join" not in plan_of(plans.QUERIES["band_join_counts"](spark, SF))


@pytest.mark.parametrize("seed", range(12))
def test_cluster_changes_equal_clusters_made_anew(seed):
    r = np.random.default_rng(seed)
    n, window, margin = 250, 0.3, float(r.choice([0.02, 0.1, 0.3]))
    t, node = np.sort(np.round(r.random(n) * n / float(r.choice([8, 40])), 2)), r.integers(0, 7, n)
    place, fresh = r.random((7, 3)) * 40, np.zeros(n, bool)
    fresh[r.choice(n, 5, replace=False)] = True
    node[fresh] = 7
    place = np.vstack([place, [[1.0, 2.0, 3.0]]])[node]
    taken, own = np.zeros(n, bool), int(n * 0.8)
    events = lambda code, group, of: sorted(tuple(of[np.flatnonzero((group == g) & (code == kernels.EVENT))].tolist()) for g in np.unique(group[code == kernels.EVENT]))
    rest = np.flatnonzero(~fresh)
    args = (340.0, margin, window, 2, 8)
    code, group = kernels.clusters(t[rest], node[rest], place[rest], taken[rest], int((rest < own).sum()), *args)
    # Seeds beyond own are those of the next slice.
    whole, seeds = kernels.clusters(t[rest], node[rest], place[rest], taken[rest], len(rest), *args)
    base = np.full(n, n)
    base[rest] = rest[seeds]
    changes, left = kernels.cluster_changes(t, node, place, base, fresh, taken, own, *args)
    now, by = kernels.clusters(t, node, place, taken, own, *args)
    was = events(code, group, rest)
    for sign, members in changes:
        was.append(tuple(members.tolist())) if sign == 1 else was.remove(tuple(members.tolist()))
    assert sorted(was) == events(now, by, np.arange(n))
    used = np.zeros(n, bool)
    used[rest] = code > 0
    assert left.tolist() == [k for k in range(own, n) if (now[k] > 0) != used[k]]


def test_null_hands_on_what_slices_leave(spark):
    r = random.Random(8)
    rows, t = [], 0.0
    for k in range(160):
        t += r.choice([0.01, 0.03, 0.06, 0.1])
        rows.append((r.choice(["a", "b", "c", "d", "e"]), k, round(t, 3)))
    survey = spark.createDataFrame([(n, 9.0 * k, 4.0 * k * k, 0.0) for k, n in enumerate("abcde")], "node string, x double, y double, z double")
    df = spark.createDataFrame(rows, "node string, seq long, t double")
    place = {x["node"]: (x["x"], x["y"], x["z"]) for x in survey.collect()}
    import hashlib
    import itertools

    def census(some):
        some = sorted(some, key=lambda x: (x[2], x[0], x[1]))
        kinds, group = kernels.associate([x[2] for x in some], [x[0] for x in some], [place[x[0]] for x in some], [False] * len(some), len(some), 340.0, 0.03, 0.2, 2, 5)
        events, out = {}, {}
        for x, kind, g in zip(some, kinds, group):
            if kind == "event":
                events.setdefault(g, []).append(x[0])
        for members in events.values():
            for pair in itertools.combinations(sorted(members), 2):
                out[pair] = out.get(pair, 0) + 1
        return out

    first, last, draws = rows[0][2], rows[-1][2], 9
    truth, counts = census(rows), []
    for draw in range(draws):
        off = int(hashlib.md5(f"5:{draw}".encode()).hexdigest()[:13], 16) / 2**52 * (last - first)
        counts.append(census([x if x[0] != "c" else ("c", x[1], first + (x[2] - first + off) % (last - first)) for x in rows]))
    want = {}
    for pair in set(truth).union(*counts):
        v = sorted(c.get(pair, 0) for c in counts)
        want[pair] = (truth.get(pair, 0), v[draws // 2], v[int(0.95 * draws)], v[-1], round(sum(v) / draws, 3))
    got = S.pair_census_null(df, survey, "c", draws, 5, 340.0, 0.03, 0.2, slice_rows=30).collect()
    assert {(x["a"], x["b"]): (x["observed"], x["median"], x["p95"], x["max"], x["mean"]) for x in got} == want


def test_pair_census_shuffles_no_pairs(spark):
    assert "MapInArrow" in plan_of(plans.QUERIES["pair_census"](spark, SF))


def test_detection_files_are_not_a_folder_each(spark, monkeypatch):
    from echofold.plans import source_queries

    paths = []
    monkeypatch.setattr(source_queries, "new_path", lambda s, make=source_queries.new_path: paths.append(make(s)) or paths[-1])
    assert plans.QUERIES["detection_files"](spark, SF).count() == 5
    assert len(paths) == 1 and not [x for x in os.listdir(paths[0].removeprefix("file:")) if "=" in x]


def test_annotation_lines_are_parsed_once(spark):
    from echofold.sources import annotations as N

    lines = spark.createDataFrame([("f", "{}")], "path string, line string")
    for rows in (N.stored_clips(lines), N.tag_rows(lines, "x")):
        assert plan_of(rows).count("parseJson") == 1


def test_chain_groups_cut_dense_slices(spark, monkeypatch):
    r, rows, t = random.Random(3), [], 0.0
    for _ in range(400):
        t += r.choice([0.0, 0.01, 0.2, 1.0])
        rows.append((r.choice("xy"), r.randint(1, 40), round(t, 2)))
    rows = sorted(set(rows), key=lambda x: (x[0], x[2], x[1]))
    want, held = [], {}
    for on, node, at in rows:
        first, last, seen = held.get(on, (None, None, set()))
        if last is None or at - last > 0.9 or node in seen:
            first, seen = at, set()
        held[on] = (first, at, seen | {node})
        want.append((on, node, at, first))
    sizes, real = [], S._settled
    monkeypatch.setattr(S, "_settled", lambda dealt, *rest: sizes.append(dealt.groupBy("slice").count().agg({"count": "max"}).first()[0]) or real(dealt, *rest))
    got = S.chain_groups(spark.createDataFrame(rows, "k string, node long, t double"), "k", 0.9, 1000.0, slice_rows=10).collect()
    assert sorted(tuple(x) for x in got) == sorted(want) and sizes[0] < 60


def test_first_wins_takes_more_tasks_for_more_rows(spark, monkeypatch):
    from echofold import scratch
    from echofold.operators import relational as R

    df = spark.range(2000).selectExpr("id % 50 AS k", "id AS o", "id % 3 AS body")
    few = {tuple(x) for x in R.first_wins(df, ["k"], ["o"], "body").collect()}
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 10)
    many = R.first_wins(df, ["k"], ["o"], "body")
    assert "REPARTITION_BY_NUM" in plan_of(many) and plan_of(many).count("Exchange hashpartitioning") == 1 and {tuple(x) for x in many.collect()} == few
