"""Sudden silence around a perimeter: several microphones whose level falls far below its slow average at once, until all of them recover.

Rows are levels (perimeter, t in seconds, kind ``level``, name of the microphone, value in dB, x, y, z or nulls) and impacts (kind ``impact``). Levels of one time are a frame. A frame is
worked on when a later one has come, so that it doesn't matter where a stream is cut. The state of a perimeter is an average and at most one silence for each microphone, the impacts
near those silences, and the last frame.
"""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.streaming.scans import scan_batch, scan_stream

COLUMNS = ["perimeter", "t", "kind", "name", "value", "x", "y", "z"]
_OUT = ["outcome", "onset_s", "recovered_s", "tau_s", "drop_db", "mics", "perimeter_m", "velocity_mps", "n_impacts", "confidence"]
SCHEMA = "outcome string, onset_s double, recovered_s double, tau_s double, drop_db double, mics array<string>, perimeter_m double, velocity_mps double, n_impacts long, confidence double"


def band_level(freqs: Column, power: Column, low: float, high: float) -> Column:
    """Level in dB of a spectrum's power between two frequencies; null where no bin lies there or the arrays differ in size."""
    inside = F.filter(F.arrays_zip(freqs.alias("f"), power.alias("p")), lambda x: x["f"].between(low, high))
    total = F.aggregate(inside, F.lit(0.0), lambda s, x: s + F.greatest(x["p"], F.lit(0.0)))
    return F.when((F.size(freqs) == F.size(power)) & (F.size(inside) > 0), 10 * F.log10(total + 1e-20))


@dataclass(frozen=True)
class Tripwire:
    drop_db: float = 9.0
    onset_s: float = 0.1
    tau_s: float = 30.0
    recovery: float = 1.0 - math.exp(-1.0)
    impact_s: float = 0.15
    least_mics: int = 2

    def __post_init__(self):
        if not 6.0 <= self.drop_db <= 12.0 or self.onset_s <= 0 or self.tau_s <= 0 or self.impact_s < 0 or not 0 < self.recovery < 1:
            raise ValueError("a drop of 6 to 12 dB, positive times and a recovery between 0 and 1 are needed")

    def level(self, mic: dict | None, t: float, db: float) -> dict:
        """A microphone's state after a level. ``onset`` is None unless it is silent; then its average stands still."""
        if mic is None:
            mic = {"base": db, "last": None, "onset": None, "trough": None, "back": None, "recovered": False}
        step = None if mic["last"] is None else max(0.0, t - mic["last"])
        drop = mic["base"] - db
        mic = mic | {"last": t}
        if mic["onset"] is None and step is not None and step <= self.onset_s and drop >= self.drop_db:
            return mic | {"onset": t, "trough": db, "back": None, "recovered": False}
        if mic["onset"] is None:
            share = 1.0 - math.exp(-step / self.tau_s) if step else 1.0
            return mic | {"base": mic["base"] + share * (db - mic["base"])}
        mic["trough"] = min(mic["trough"], db)
        if drop <= self.drop_db / 2:
            mic["back"] = t if mic["back"] is None else mic["back"]
            mic["recovered"] = (db - mic["trough"]) / max(1e-9, mic["base"] - mic["trough"]) >= self.recovery
        return mic

    def frame(self, state: dict, t: float, levels: list) -> list | None:
        """One frame: the levels of all microphones at a time. Gives an event if a silence ends with it."""
        mics, places = state["mics"], state["places"]
        for name, db, place in levels:
            mics[name] = self.level(mics.get(name), t, db)
            if place is not None:
                places[name] = place
        silent = {n: m["onset"] for n, m in mics.items() if m["onset"] is not None}
        first = min(silent.values(), default=None)
        state["impacts"] = [x for x in state["impacts"] if x >= (t if first is None else first) - self.impact_s - self.onset_s]
        group = {n: at for n, at in silent.items() if at - first <= self.onset_s}
        if len(group) < self.least_mics or not all(mics[n]["recovered"] for n in group):
            return None
        for n in silent:
            mics[n] = mics[n] | {"onset": None}
        return self._event(state, t, first, group)

    def _event(self, state: dict, t: float, first: float, group: dict) -> list:
        mics = [state["mics"][n] for n in group]
        points = [state["places"][n] for n in group if n in state["places"]]
        across = max((math.dist(a, b) for a in points for b in points), default=0.0)
        spread = max(group.values()) - first
        scale = max(1e-9, -math.log(max(1e-9, 1.0 - self.recovery)))
        taus = [(m["back"] - group[n]) / scale for n, m in zip(group, mics) if m["back"] is not None]
        hits = sum(abs(x - first) <= self.impact_s for x in state["impacts"])
        sure = min(1.0, len(group) / max(1, self.least_mics)) * (1.0 if hits else 0.75)
        return ["silenced", first, t, statistics.median(taus) if taus else None, statistics.median(m["base"] - m["trough"] for m in mics), sorted(group), across, across / spread if across and spread > 0 else None, hits, sure]

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, list]:
        """Rows in order of time; the newest frame stays pending."""
        state = state or {"mics": {}, "places": {}, "impacts": [], "at": None, "pending": [], "refused": 0}
        out = []
        for t, kind, name, value, x, y, z in zip(*(rows[c].tolist() for c in COLUMNS[1:])):
            if t is None or t != t or value is None and kind != "impact" or kind == "level" and not math.isfinite(value):
                out.append(["not_finite", None if t is None or t != t else t, *[None] * 8])
                continue
            if kind == "impact":
                state["impacts"] = sorted([*state["impacts"], t])
                continue
            if state["at"] is not None and t < state["at"]:
                out.append(["time_went_back", t, *[None] * 8])
                continue
            if state["at"] is not None and t > state["at"]:
                out += [e for e in [self.frame(state, state["at"], state["pending"])] if e]
                state["pending"] = []
            state["at"] = t
            state["pending"].append([name, value, None if x is None or x != x else [x, y, z]])
        return state, out

    def end(self, state: dict) -> list:
        return [e for e in [self.frame(state, state["at"], state["pending"])] if e] if state["pending"] else []


def _table(perimeter, rows: list) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=_OUT)
    table.insert(0, "perimeter", pd.Series([perimeter] * len(rows), dtype=object))
    return table


def _machine(rows: DataFrame, wire: Tripwire):
    kind = rows.schema["perimeter"].dataType.simpleString()

    def step(state, part):
        before = None if state is None else state["wire"]
        name = part["perimeter"].iloc[0]
        name = name.item() if hasattr(name, "item") else name
        after, out = wire.step(before, part.astype(object).where(part.notna(), None))
        return {"wire": after, "name": name}, _table(name, out)

    return step, lambda state: _table(state["name"], wire.end(state["wire"])), f"perimeter {kind}, {SCHEMA}"


def silences(rows: DataFrame, wire: Tripwire = Tripwire()) -> DataFrame:
    """Silences of each perimeter, and rows that were refused: ``not_finite``, or ``time_went_back`` (never in a batch, which is sorted).

    Impacts of the same time come before levels; of levels of one microphone and time the last by value counts.
    """
    step, end, schema = _machine(rows, wire)
    return scan_batch(rows.select(*COLUMNS), "perimeter", ["t", "kind", "name", "value"], step, schema, end)


def silence_stream(stream: DataFrame, wire: Tripwire = Tripwire(), idle_s: float | None = None, time: str = "ts") -> DataFrame:
    """The same on a stream. With ``idle_s`` the stream has a timestamp with a watermark as well, and a perimeter silent for so long by event time ends."""
    step, end, schema = _machine(stream, wire)
    columns = [*COLUMNS, *([time] if idle_s is not None else [])]
    return scan_stream(stream.select(*columns), "perimeter", ["t", "kind", "name", "value"], step, schema, end, idle_s, time if idle_s is not None else None)
