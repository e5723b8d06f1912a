"""Fits over groups of arrivals: many groups at once, one task solves a group with all its arrivals, which the array and its events bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions import kernels
from echofold.scratch import spread


#: Events that are fitted at once.
FIT_EVENTS = 1 << 16


def joint_calibration(
    arrivals: DataFrame, survey: DataFrame, speed: float, fixed_up: float = 0.0, margin: float = 500.0, step: float = 10.0, kinds: tuple[str, ...] = ("set", "node", "event")
) -> DataFrame:
    """Sources and clock biases of sets of events, fitted together.

    ``arrivals`` (set, event, node, t in seconds, biased): which of a set's nodes have an unknown offset is stated with their arrivals. ``survey`` (node, x, y, z).
    A set gives a row of kind ``set`` with its counts and refusal, and if it is solved a row for each node (bias_s, sigma_s) and each event (e_m, n_m), as far as ``kinds`` asks for them. Arrivals without a time or of nodes
    that aren't surveyed take no part; a node heard twice in an event counts by its first arrival.
    """
    known = survey.select("node", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")])
    # Dealt by set once, for both groupings.
    dealt = spread(arrivals.where("t is not null").select("set", "event", "node", F.col("t").cast("double").alias("t"), "biased"), "set")
    rows = dealt.groupBy("set", "event", "node").agg(F.min("t").alias("t"), F.bool_or("biased").alias("biased")).join(known, "node")
    kind = arrivals.schema["set"].dataType.simpleString()
    names = ["set", "kind", "id", "e_m", "n_m", "bias_s", "sigma_s", "rms_s", "n_events", "n_equations", "n_unknowns", "refusal"]

    def fitted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        heard = batch.column("heard")
        size, heard = np.diff(heard.offsets.to_numpy()), heard.flatten()
        of = np.repeat(np.arange(len(batch)), size)
        codes = {}
        for c in ("event", "node"):
            codes[c] = pd.factorize(pd.Series(heard.field(c).to_pandas()), sort=True)
        # A set's own events and nodes by number, in their order.
        event, node = [_numbered(of, codes[c][0]) for c in ("event", "node")]
        count, place = np.bincount(event[1], minlength=len(batch)), np.cumsum(np.bincount(node[1], minlength=len(batch))) - np.bincount(node[1], minlength=len(batch))
        column = node[0] - place[of]
        width = int(column.max()) + 1
        t, p, flags = np.full((len(event[1]), width), np.nan), np.full((len(batch), width, 3), np.nan), np.zeros((len(batch), width), bool)
        t[event[0], column] = heard.field("t").to_numpy()
        p[of, column] = np.stack([heard.field(c).to_numpy() for c in "xyz"], axis=1)
        biased = heard.field("biased").fill_null(False).to_numpy(zero_copy_only=False)
        flags[of[biased], column[biased]] = True
        fit = kernels.joint_fits(p, t, flags, count, speed, fixed_up, margin, step)

        def given(kind: str, of, ids, **values) -> pa.RecordBatch:
            none = lambda t: pa.nulls(len(of), t)
            number = lambda v: pa.array(v, pa.float64(), from_pandas=True)
            counts = [pa.array(v[of], pa.int64()) for v in (count, fit["n_equations"], fit["n_unknowns"])]
            some = [number(values[c]) if c in values else none(pa.float64()) for c in ("e_m", "n_m", "bias_s", "sigma_s", "rms_s")]
            columns = [batch.column("set").take(pa.array(of)), pa.array([kind] * len(of), pa.string()), none(pa.string()) if ids is None else pa.array(ids, pa.string()), *some, *counts, pa.array(fit["refusal"][of], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names)

        if "set" in kinds:
            yield given("set", np.arange(len(batch)), None, rms_s=fit["rms_s"])
        # Each node's and event's set, and its place in the order of all.
        if "node" in kinds:
            some = fit["fitted"][node[1]]
            at, k = node[1][some], (np.arange(len(node[1])) - place[node[1]])[some]
            yield given("node", at, [str(codes["node"][1][c]) for c in node[2][some]], bias_s=fit["bias_s"][at, k], sigma_s=fit["sigma_s"][at, k])
        if "event" in kinds:
            some = fit["fitted"][event[1]]
            yield given("event", event[1][some], [str(codes["event"][1][c]) for c in event[2][some]], e_m=fit["source"][some, 0], n_m=fit["source"][some, 1])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.searchsorted(np.cumsum(batch.column("n_events").to_numpy()), np.arange(FIT_EVENTS, int(np.sum(batch.column("n_events").to_numpy())) + FIT_EVENTS, FIT_EVENTS), side="right")
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if a < b:
                    yield from fitted(batch.slice(a, b - a))

    schema = f"set {kind}, kind string, id string, e_m double, n_m double, bias_s double, sigma_s double, rms_s double, n_events long, n_equations long, n_unknowns long, refusal string"
    sets = rows.groupBy("set").agg(F.count(F.lit(1)).alias("n_events"), F.collect_list(F.struct("event", "node", "x", "y", "z", "t", "biased")).alias("heard"))
    return sets.mapInArrow(solve, schema)


def _numbered(of, codes):
    """For values by their ``codes`` in sets ``of``: the number of each among all distinct ones of the sets, and by number the set and the code."""
    kinds, number = np.unique(of * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    return number.reshape(-1), kinds // (int(codes.max(initial=0)) + 1), kinds % (int(codes.max(initial=0)) + 1)


def known_source_offset(path_m: Column, sigma_pos_m: Column, sigma_node_s: Column, sigma_pick_s: Column, sigma_temp_c: Column, temp_c: Column, n_chirps: Column, source_moves: Column) -> Column:
    """What hearing a source of known place and time says of a clock's offset: survey_s, pick_s, node_s, speed_s, single_s, averaged_s, limiting and refusal.

    Picking and the clock average out over repetitions, the survey does if the source moves, the speed of sound never does.
    """
    # Speed of sound in dry air by temperature.
    c = 331.3 * F.sqrt(1 + temp_c / 273.15)
    slope = 331.3 / (2 * 273.15 * F.sqrt(1 + temp_c / 273.15))
    terms = {"survey": sigma_pos_m / c, "onset_pick": sigma_pick_s, "node_clock": sigma_node_s, "sound_speed": path_m / c * F.abs(sigma_temp_c) * slope / c}
    squares = {k: v * v for k, v in terms.items()}
    single = F.sqrt(squares["survey"] + squares["onset_pick"] + squares["node_clock"] + squares["sound_speed"])
    mean = F.sqrt(F.when(source_moves, squares["survey"] / n_chirps).otherwise(squares["survey"]) + (squares["onset_pick"] + squares["node_clock"]) / n_chirps + squares["sound_speed"])
    most = F.greatest(*terms.values())
    limiting = F.coalesce(*[F.when(v == most, k) for k, v in terms.items()])
    refusal = F.when(~(path_m > 0), "no_path").when(~(n_chirps >= 1), "no_chirps")
    named = {"survey_s": terms["survey"], "pick_s": terms["onset_pick"], "node_s": terms["node_clock"], "speed_s": terms["sound_speed"], "single_s": single, "averaged_s": mean, "limiting": limiting}
    return F.struct(*[F.when(refusal.isNull(), v).alias(k) for k, v in named.items()], refusal.alias("refusal"))


def cone_fits(arrivals: DataFrame, survey: DataFrame, mach_speed: str, sound_speed: float, passed: str | None = None) -> DataFrame:
    """Bearing, offset and residual of the path of a supersonic source for each event (event, node, t, and its speed in the column ``mach_speed``).

    Refused: ``subsonic`` and ``too_few_arrivals`` (four at least, as bearing, offset and time are unknown). The offset of a path that all nodes lie on one side of can't be told from arrivals: it is null, unless the column
    ``passed`` gives the time at which the source was abreast of the survey's origin. Nothing else is taken from that time.
    """
    known = survey.select("node", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")])
    rows = arrivals.where("t is not null").join(known, "node").groupBy("event").agg(F.sort_array(F.collect_list(F.struct("node", "x", "y", "z", F.col("t").cast("double").alias("t")))).alias("heard"), F.any_value(F.col(mach_speed).cast("double")).alias("v"), F.any_value(F.col(passed).cast("double") if passed else F.lit(None).cast("double")).alias("passed"))
    kind = arrivals.schema["event"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for event, heard, v, at in zip(batch["event"], batch["heard"], batch["v"], batch["passed"]):
                refusal = "subsonic" if not v > sound_speed else "too_few_arrivals" if len(heard) < 4 else None
                t0 = min(a["t"] for a in heard)
                fit = (None, None, None) if refusal else kernels.mach_cone([(a["x"], a["y"], a["z"]) for a in heard], [a["t"] - t0 for a in heard], v, sound_speed, passed=None if pd.isna(at) else at - t0)
                out.append((event, len(heard), *fit, refusal))
            yield pd.DataFrame(out, columns=["event", "n_nodes", "bearing_deg", "offset_m", "rms_s", "refusal"])

    return spread(rows, "event").mapInPandas(solve, f"event {kind}, n_nodes int, bearing_deg double, offset_m double, rms_s double, refusal string")
