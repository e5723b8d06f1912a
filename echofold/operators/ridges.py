"""Sounds that pass by: frequency ridges of clips and one Doppler curve through all receivers' ridges; and surface waves: phase velocities by frequency and the layers that explain them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.scratch import spread


def least_squares(residual: Callable, x0, low, high, scale: float | None = None, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Damped least squares within bounds, with slopes by differences: cost and place. With ``scale`` residuals beyond it count by their size only (soft L1)."""
    x, low, high = (np.asarray(v, float) for v in (x0, low, high))

    def judged(x):
        r = residual(x)
        if scale is None:
            return r, np.ones_like(r), float((r * r).sum())
        z = (r / scale) ** 2
        return r, 1 / np.sqrt(1 + z), float(2 * scale**2 * (np.sqrt(1 + z) - 1).sum())

    r, w, cost = judged(x)
    damp = 1e-3
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(x), 1e-3)
        jac = np.stack([(residual(np.where(np.arange(len(x)) == k, x + step, x)) - r) / step[k] for k in range(len(x))], axis=1)
        normal, slope = (jac * w[:, None]).T @ jac, (jac * w[:, None]).T @ r
        while damp < 1e12:
            new = np.clip(x - np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-18), slope, rcond=None)[0], low, high)
            found = judged(new)
            if found[2] < cost:
                break
            damp *= 5
        else:
            break
        done = np.abs(new - x).max() < 1e-12 * (1 + np.abs(x).max()) or cost - found[2] < 1e-15 * cost
        x, (r, w, cost), damp = new, found, max(damp / 5, 1e-12)
        if done:
            break
    return cost, x


def _spectra(x: np.ndarray, fs: float, size: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes and momentary frequencies (from the phase's advance over a hop) of windows, a row each."""
    starts = np.arange((len(x) - size) // hop + 1) * hop
    z = np.fft.rfft(x[starts[:, None] + np.arange(size)] * np.hanning(size + 1)[:-1], axis=1)
    freqs = np.arange(z.shape[1]) * fs / size
    hz = np.repeat(freqs[None], len(starts), axis=0)
    if len(starts) > 1:
        advance = np.angle(z[1:] * np.conj(z[:-1]) * np.exp(-2j * np.pi * np.arange(z.shape[1]) * hop / size))
        hz[1:] += advance * fs / (2 * np.pi * hop)
    return np.abs(z), hz


def tracks_of(x: np.ndarray, fs: float, size: int, hop: int, low: float, high: float, most: int, least: int) -> list[list[tuple[int, float, float]]]:
    """Ridges, loudest first: (window, hz, amplitude) of peaks that follow each other, nearest first, with one window missing at most."""
    magnitude, hz = _spectra(x, fs, size, hop)
    a, b = max(0, int(low * size / fs)), min(magnitude.shape[1], int(np.ceil(high * size / fs)) + 1)
    reach = max(3.0 * fs / size, 0.04 * (high - low))
    live: list[dict] = []
    done: list[dict] = []
    for n in range(len(magnitude)):
        m = magnitude[n, a:b]
        at = np.flatnonzero((m[1:-1] > m[:-2]) & (m[1:-1] >= m[2:])) + 1
        at = at[np.argsort(-m[at], kind="stable")][: 2 * most]
        free = [(float(hz[n, a + k]), float(m[k])) for k in at if low <= hz[n, a + k] <= high]
        for track in live:
            near = min(free, key=lambda p: abs(p[0] - track["hz"]), default=None)
            if near is not None and abs(near[0] - track["hz"]) <= reach:
                free.remove(near)
                track["points"].append((n, *near))
                track["hz"], track["missed"] = near[0], 0
            else:
                track["missed"] += 1
        done += [t for t in live if t["missed"] > 1]
        live = [t for t in live if t["missed"] <= 1] + [{"points": [(n, *p)], "hz": p[0], "missed": 0} for p in free]
    found = [t["points"] for t in done + live if len(t["points"]) >= least]
    return sorted(found, key=lambda t: -float(np.mean([p[2] for p in t])))[:most]


def ridges(clips: DataFrame, size: int = 2048, hop: int = 512, low: float = 40.0, high: float | None = None, most: int = 8, least: int = 3) -> DataFrame:
    """Points (set, receiver, track, t, hz, amplitude) of the ridges of clips (set, receiver, start_s, fs, samples); tracks are numbered from the loudest. Clips shorter than a window have none."""
    if size < 32 or size & (size - 1) or not 0 < hop <= size:
        raise ValueError("a window must be a power of two of 32 or more, and a hop no longer")
    kinds = {c: clips.schema[c].dataType.simpleString() for c in ("set", "receiver")}
    good = clips.where("samples is not null and fs > 0").select("set", "receiver", F.col("start_s").cast("double"), F.col("fs").cast("double"), F.col("samples").cast("array<double>"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, receiver, start, fs, samples in zip(*(batch[c] for c in batch.columns)):
                x = np.nan_to_num(np.asarray(samples, float))
                if len(x) < size:
                    continue
                found = tracks_of(x, fs, size, hop, low, fs / 2 if high is None else high, most, least)
                rows = [(name, receiver, k, start + (n * hop + size / 2) / fs, hz, amplitude) for k, points in enumerate(found) for n, hz, amplitude in points]
                yield pd.DataFrame(rows, columns=["set", "receiver", "track", "t", "hz", "amplitude"])

    return good.mapInPandas(follow, f"set {kinds['set']}, receiver {kinds['receiver']}, track int, t double, hz double, amplitude double")


def doppler_hz(t, f0, v, t_cpa, d, x, speed: float):
    """Frequency at a receiver at ``x`` along the path: the source passes at ``t_cpa`` and distance ``d``. For numbers, arrays and columns."""
    along = v * (t - t_cpa) - x
    root = F.sqrt if isinstance(along, Column) else np.sqrt
    return f0 * (1.0 - (v / speed) * along / root(along * along + d * d))


class _Passings:
    """The points of many passings at once, in order of their sets, and the fits of one curve (f0, v, t_cpa, d) to each set's. Residuals beyond ``scale`` Hz count by their size only (soft L1)."""

    def __init__(self, t, hz, x, count, speed: float, scale: float):
        self.t, self.hz, self.x, self.count, self.speed, self.scale = t, hz, x, count, speed, scale
        self.of, self.first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count

    def take(self, sets, most: int | None = None):
        """The same for some sets, which may come again; of each ``most`` points at even steps, if it has more."""
        count, first = self.count[sets], self.first[sets]
        some = count if most is None else np.minimum(count, most)
        k = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        at = np.repeat(first, some) + (k if most is None else k * np.repeat(count, some) // np.repeat(some, some))
        return _Passings(self.t[at], self.hz[at], self.x[at], some, self.speed, self.scale)

    def sums(self, values):
        return np.add.reduceat(values, self.first)

    def bounds(self):
        """Of speeds, times and distances; times begin at a set's first."""
        span = np.maximum(np.maximum.reduceat(self.t, self.first), 1.0)
        none = np.zeros(len(span))
        return np.stack([none + 1e-6, none - 0.99 * self.speed, -10 * span, none + 1e-6], axis=1), np.stack([none + np.inf, none + 0.99 * self.speed, 11 * span, none + np.inf], axis=1)

    def judged(self, p):
        """Costs, and of each point the residual, how far along the path it is heard and the distance then."""
        f0, v, t_cpa, d = (c[self.of] for c in p.T)
        a = v * (self.t - t_cpa) - self.x
        root = np.sqrt(a * a + d * d)
        r = f0 * (1.0 - (v / self.speed) * a / root) - self.hz
        z = (r / self.scale) ** 2
        # What is left of small residuals must not be lost beside one.
        return self.sums(2 * self.scale**2 * z / (1 + np.sqrt(1 + z))), r, a, root

    def with_pitch(self, v, t_cpa, d):
        """Starts with the frequency that fits best."""
        g = 1.0 - (v / self.speed)[self.of] * (lambda a: a / np.sqrt(a * a + d[self.of] ** 2))(v[self.of] * (self.t - t_cpa[self.of]) - self.x)
        return np.stack([np.maximum(self.sums(g * self.hz) / np.maximum(self.sums(g * g), 1e-12), 1e-6), v, t_cpa, d], axis=1)

    def descend(self, p, rounds: int):
        """Costs and places where damped least squares from ``p`` end."""
        part, sets, p = self, np.arange(len(self.count)), p.copy()
        low, high = self.bounds()
        now, damp, done = p.copy(), np.full(len(p), 1e-3), np.zeros(len(p), bool)
        cost = np.full(len(p), np.inf)
        before, r, a, root = part.judged(now)
        for k in range(rounds):
            f0, v, t_cpa, d = (c[part.of] for c in now.T)
            w = np.sqrt(1 / np.sqrt(1 + (r / part.scale) ** 2))
            share, along = v / part.speed, a / root
            by_a = -f0 * share * (d * d) / root**3
            slopes = [(1.0 - share * along) * w, (by_a * (part.t - t_cpa) - f0 / part.speed * along) * w, -v * by_a * w, f0 * share * along * d / (root * root) * w]
            r = r * w
            normal, down = np.empty((len(sets), 4, 4)), np.stack([part.sums(s * r) for s in slopes], axis=1)
            for i in range(4):
                for j in range(i, 4):
                    normal[:, i, j] = normal[:, j, i] = part.sums(slopes[i] * slopes[j])
            # Of one size, so that the unknowns' units don't matter.
            size = np.sqrt(np.einsum("kii->ki", normal) + 1e-18)
            normal = normal / size[:, :, None] / size[:, None, :] + (damp[:, None, None] + 1e-15) * np.eye(4)
            new = np.clip(now - np.linalg.solve(normal, (down / size)[..., None])[..., 0] / size, low, high)
            after, *found = part.judged(new)
            better = (after < before) & ~done
            moved = np.abs(new - now).max(axis=1) < 1e-12 * (1 + np.abs(now).max(axis=1))
            done |= np.where(better, moved | (before - after < 1e-15 * before), damp * 5 >= 1e12)
            damp = np.where(done, 1.0, np.where(better, np.maximum(damp / 5, 1e-12), damp * 5))
            now, before = np.where(better[:, None], new, now), np.where(better, after, before)
            if done.all() or 3 * done.sum() >= len(done) or k == rounds - 1:
                p[sets], cost[sets] = now, before
                if done.all():
                    break
                keep = np.flatnonzero(~done)
                part, now, damp, sets, low, high, done = part.take(keep), now[keep], damp[keep], sets[keep], low[keep], high[keep], done[keep]
                before, r, a, root = part.judged(now)
            else:
                of = better[part.of]
                r, a, root = (np.where(of, y, x) for x, y in zip((r / w, a, root), found))
        return cost, p


#: Points of a set that tell where to begin, mean square residual (Hz) of an exact fit, and points that are fitted at once.
_BEGIN_POINTS, _EXACT_HZ2, FIT_POINTS = 32, 1e-16, 1 << 17


def passing_fits(t, hz, x, count, speed: float, scale: float):
    """Costs and curves (f0, v, t_cpa, d) through the points of sets that have ``count`` points in a row each; times begin at a set's first.

    Each set's beginnings are tried on some of its points, and the best is fitted to all. A fit that isn't exact is begun again on all points from all beginnings, and then from the best of a grid. Of equal fits the one that moves forwards is taken.
    """
    whole, n = _Passings(t, hz, x, np.asarray(count), speed, scale), len(count)
    span = np.maximum(np.maximum.reduceat(t, whole.first), 1.0)
    cost, p = np.full(n, np.inf), np.zeros((n, 4))

    def best(sets, found, places):
        """The best of each set's fits, and of what it had."""
        every, c, q = np.concatenate([np.arange(n), sets]), np.concatenate([cost, found]), np.concatenate([p, places])
        exact = c <= _EXACT_HZ2 * whole.count[every]
        order = np.lexsort((-q[:, 1], np.where(exact, 0.0, np.round(c, 9)), ~exact, every))
        first = order[np.concatenate([[True], np.diff(every[order]) > 0])]
        cost[:], p[:] = c[first], q[first]

    def begun(sets, most, rounds):
        """Fits from each of the beginnings."""
        v, share = (g.ravel() for g in np.meshgrid([min(30.0, 0.2 * speed), -min(30.0, 0.2 * speed)], [0.5, 0.25, 0.75]))
        of = np.repeat(sets, len(v))
        part = whole.take(of, most)
        return of, *part.descend(part.with_pitch(np.tile(v, len(sets)), np.tile(share, len(sets)) * span[of], np.full(len(of), 10.0)), rounds)

    def lots(sets, times: int):
        """Sets whose points, so many times over, are held at once."""
        held = np.cumsum(whole.count[sets] * times)
        return [s for s in np.split(sets, np.searchsorted(held, np.arange(FIT_POINTS, held[-1], FIT_POINTS))) if len(s)] if len(sets) else []

    for sets in lots(np.arange(n), 2):
        of, c, q = begun(sets, _BEGIN_POINTS, 40)
        top = np.lexsort((-q[:, 1], np.round(c, 9), of))[:: len(of) // len(sets)]
        part = whole.take(sets)
        best(sets, *part.descend(q[top], 60))
    inexact = lambda: np.flatnonzero(cost > _EXACT_HZ2 * whole.count)
    for sets in lots(inexact(), 6):
        best(*begun(sets, None, 200))
    # Few points have many near misses: these are begun from a finer grid as well.
    for speeds, times, distances, fits, most in _GRIDS:
        some = inexact()
        for sets in lots(some[whole.count[some] <= most], fits):
            of, starts = _grid_starts(whole, sets, span, speeds, times, distances, fits)
            part = whole.take(of)
            best(of, *part.descend(part.with_pitch(*starts), 200))
    return cost, p


#: Grids of speeds (of sound), times (of the span) and distances, how many of a grid's points a fit is begun from, and for how many points at most.
_GRIDS = [
    ((0.01, 0.02, 0.03, 0.045, 0.065, 0.09, 0.13, 0.2, 0.35, 0.6), np.arange(-0.5, 1.55, 0.1), (0.7, 1.5, 3.0, 5.5, 9.0, 14.0, 22.0, 40.0, 90.0), 40, 1 << 40),
    (np.geomspace(0.008, 0.7, 24), np.arange(-0.5, 1.53, 0.04), np.geomspace(0.5, 100.0, 20), 300, _BEGIN_POINTS),
]


def _grid_starts(whole: _Passings, sets, span, speeds, times, distances, fits: int):
    """Speed, time and distance of the best points of a grid for each of the sets, which come as often as there are."""
    v, share, d = (g.ravel() for g in np.meshgrid([s * c * whole.speed for s in (1, -1) for c in speeds], times, distances, indexing="ij"))
    of, starts = np.repeat(sets, fits), np.empty((3, len(sets), fits))
    for k, s in enumerate(sets):
        at = slice(whole.first[s], whole.first[s] + whole.count[s])
        t, hz, x = whole.t[at], whole.hz[at], whole.x[at]
        gg, gb = np.zeros(len(v)), np.zeros(len(v))
        # A point at a time: as many numbers as the grid has points.
        for a, b, c in zip(t, hz, x):
            along = v * (a - share * span[s]) - c
            g = 1.0 - v / whole.speed * along / np.sqrt(along * along + d * d)
            gg, gb = gg + g * g, gb + g * b
        left = ((hz * hz).sum() - gb**2 / gg).reshape(2 * len(speeds), len(times), len(distances))
        # Points that no neighbour is below, and then the others.
        wide = np.pad(left, 1, constant_values=np.inf)
        low = np.ones(left.shape, bool)
        for axis in range(3):
            for step in (0, 2):
                low &= left <= wide[tuple(slice(step, step + left.shape[j]) if j == axis else slice(1, -1) for j in range(3))]
        top = np.lexsort((left.ravel(), ~low.ravel()))[:fits]
        starts[:, k] = np.stack([v[top], share[top] * span[s], d[top]])
    return of, starts.reshape(3, -1)


def doppler_fits(points: DataFrame, receivers: DataFrame, speed: float = 343.0, scale: float = 1.0) -> DataFrame:
    """One curve through the points (set, receiver, t, hz) of each passing: f0_hz, v_mps, t_cpa_s, d_m, rms_hz, n and refusal (``too_few_points`` below eight).

    ``receivers`` (receiver, x_m): places along the path; points of others take no part. Residuals beyond ``scale`` Hz count by their size only. Of equal fits the one that moves forwards is given.
    A task reads its sets' points in a row and fits those of many sets at once.
    """
    heard = points.where("t is not null and hz > 0").join(receivers.select("receiver", F.col("x_m").cast("double").alias("x")), "receiver")
    dealt = spread(heard.select("set", F.col("t").cast("double").alias("t"), F.col("hz").cast("double").alias("hz"), "x"), "set")
    names = ["set", "n", "f0_hz", "v_mps", "t_cpa_s", "d_m", "rms_hz", "refusal"]

    def fitted(table: pa.Table, cuts) -> pa.RecordBatch:
        """Rows of a table that begins a set at each of ``cuts``."""
        n, few = np.diff(cuts), np.diff(cuts) < 8
        t, hz, x = (table.column(c).to_numpy()[np.repeat(~few, n)] for c in ("t", "hz", "x"))
        out, count = np.full((len(n), 5), np.nan), n[~few]
        if len(count):
            first = np.cumsum(count) - count
            t0 = np.minimum.reduceat(t, first)
            t = t - np.repeat(t0, count)
            _, p = passing_fits(t, hz, x, count, speed, scale)
            off = doppler_hz(t, *(np.repeat(c, count) for c in p.T), x, speed) - hz
            out[~few] = np.column_stack([p[:, 0], p[:, 1], p[:, 2] + t0, p[:, 3], np.sqrt(np.add.reduceat(off * off, first) / count)])
        given = [pa.array(c, pa.float64(), from_pandas=True) for c in out.T]
        sets = table.column("set").take(pa.array(cuts[:-1])).combine_chunks()
        return pa.RecordBatch.from_arrays([sets, pa.array(n, pa.int64()), *given, pa.array(np.where(few, "too_few_points", None), pa.string())], names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + len(batch)
            if rows >= FIT_POINTS:
                table = pa.Table.from_batches(held)
                cuts = _cuts(table.column("set"))
                if len(cuts) > 2:
                    yield fitted(table.slice(0, int(cuts[-2])), cuts[:-1])
                # The last set may go on.
                held, rows = table.slice(int(cuts[-2])).to_batches(), rows - int(cuts[-2])
        if rows:
            table = pa.Table.from_batches(held)
            yield fitted(table, _cuts(table.column("set")))

    kind = points.schema["set"].dataType.simpleString()
    return dealt.sortWithinPartitions("set").mapInArrow(fit, f"set {kind}, n long, f0_hz double, v_mps double, t_cpa_s double, d_m double, rms_hz double, refusal string")


def _cuts(sets) -> np.ndarray:
    """Where a sorted column's values begin, and its end."""
    codes = pd.factorize(sets.to_pandas())[0]
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def phase_velocities(arrivals: DataFrame, least_stations: int = 3) -> DataFrame:
    """Velocity of each frequency (set, hz, velocity_mps, n_stations, refusal) over stations (set, hz, distance_m, delay_s): the slope of distance by delay, by one aggregation.

    Refused: ``too_few_stations``, ``no_aperture`` (all at one distance) and ``backwards`` (the farther the sooner).
    """
    good = arrivals.where("hz > 0 and distance_m is not null and delay_s is not null")
    sums = good.groupBy("set", "hz").agg(F.count_distinct("distance_m").alias("n_stations"), F.regr_slope("delay_s", "distance_m").alias("slowness"))
    refusal = F.when(F.col("n_stations") < 2, "no_aperture").when(F.col("n_stations") < least_stations, "too_few_stations").when(~(F.col("slowness") > 0), "backwards")
    return sums.select("set", "hz", F.when(refusal.isNull(), 1 / F.col("slowness")).alias("velocity_mps"), "n_stations", refusal.alias("refusal"))


#: A stiff layer (Young's modulus, Poisson's ratio, density) over soil (ratio, density).
LAYER, SOIL = (4e9, 0.35, 2400.0), (0.30, 1800.0)


def _surface(shear, ratio: float):
    return shear * (0.862 + 1.14 * ratio) / (1 + ratio)


def layered_velocity(hz, h, soil_shear):
    """Phase velocity of a surface wave over a layer of thickness ``h``: slow waves feel the soil, short ones the layer. For numbers, arrays and columns."""
    exp = F.exp if isinstance(hz, Column) or isinstance(h, Column) or isinstance(soil_shear, Column) else np.exp
    top, below = _surface(float(np.sqrt(LAYER[0] / (2 * LAYER[2] * (1 + LAYER[1])))), LAYER[1]), _surface(soil_shear, SOIL[0])
    depth = exp(-2 * np.pi * h * hz / below)
    share = depth / (1 + depth)
    return top * (1 - share) + below * share


def layer_fits(velocities: DataFrame, start: tuple[float, float] = (0.08, 150.0)) -> DataFrame:
    """Thickness of the layer and shear velocity and modulus of the soil that explain the velocities (set, hz, velocity_mps) of each set: h_m, shear_mps, modulus_pa, rms_mps, n, refusal (``too_few_picks`` below two)."""
    kind = velocities.schema["set"].dataType.simpleString()
    good = velocities.where("velocity_mps > 0 and hz > 0").select("set", F.col("hz").cast("double").alias("hz"), F.col("velocity_mps").cast("double").alias("c"))

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        hz, c = batch["hz"].to_numpy(float), batch["c"].to_numpy(float)
        names = ["set", "n", "h_m", "shear_mps", "modulus_pa", "rms_mps", "refusal"]
        if len(set(hz)) < 2:
            return pd.DataFrame([(batch["set"].iloc[0], len(hz), None, None, None, None, "too_few_picks")], columns=names)
        # The soil in hundreds of metres a second, so that both unknowns are of one size.
        off = lambda p: (layered_velocity(hz, p[0], 100 * p[1]) - c) / np.maximum(c, 1.0)
        starts = [(start[0] * a, start[1] / 100 * b) for a in (1, 0.3, 3) for b in (1, 2, 4)]
        _, (h, shear) = min((least_squares(off, s, [0.005, 0.5], [1.0, 20.0]) for s in starts), key=lambda found: found[0])
        rms = float(np.sqrt(np.mean((off((h, shear)) * np.maximum(c, 1.0)) ** 2)))
        return pd.DataFrame([(batch["set"].iloc[0], len(hz), h, 100 * shear, SOIL[1] * (100 * shear) ** 2, rms, None)], columns=names)

    return good.groupBy("set").applyInPandas(fit, f"set {kind}, n long, h_m double, shear_mps double, modulus_pa double, rms_mps double, refusal string")
