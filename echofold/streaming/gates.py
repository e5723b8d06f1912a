"""Gates that carry state from sample to sample of a channel: the same step for a batch, by groups, and for a stream, by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from echofold.streaming.scans import scan_batch


class LevelGate:
    """A floor that follows the level, slowly up and quickly down, and an onset where the level exceeds it by a factor; it arms again once the level is back."""

    def __init__(self, rise: float = 0.02, fall: float = 0.1, factor: float = 3.0, rearm: float = 0.35):
        self.rise, self.fall, self.factor, self.rearm = rise, fall, factor, rearm

    def step(self, state: tuple[float, bool] | None, x: float) -> tuple[tuple[float, bool], bool]:
        """New state (floor, armed) and whether this sample is an onset."""
        if state is None:
            return (x, True), False
        floor, armed = state
        limit = floor * self.factor
        onset = armed and x > limit
        armed = not onset and (armed or x < limit * self.rearm)
        return (floor + (self.rise if x > floor else self.fall) * (x - floor), armed), onset

    def run(self, values, state=None):
        flags, floors = [], []
        for x in values:
            state, onset = self.step(state, float(x))
            flags.append(onset)
            floors.append(state[0])
        return flags, floors, state


def level_onsets(rows: DataFrame, by: str, order: list[str], level: str, gate: LevelGate = LevelGate()) -> DataFrame:
    """``rows`` (by, order, level) with ``onset`` and ``floor``; a channel's samples go through one after another, a piece of a batch at a time."""
    names = rows.columns

    def step(state: dict | None, part: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        flags, floors, after = gate.run(part[level].tolist(), None if state is None else tuple(state["gate"]))
        return {"gate": after}, part[names].assign(onset=flags, floor=floors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return scan_batch(rows, by, order, step, f"{fields}, onset boolean, floor double")


def level_onset_stream(stream: DataFrame, by: str, order: list[str], level: str, gate: LevelGate = LevelGate()) -> DataFrame:
    """The same on a stream: each channel's floor and whether it is armed are its state, samples of a batch are taken in order."""
    names = stream.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def solve(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches)).sort_values(order, kind="stable")
        before = (state.get[0], bool(state.get[1])) if state.exists else None
        flags, floors, after = gate.run(b[level].tolist(), before)
        state.update((float(after[0]), bool(after[1])))
        yield b[names].assign(onset=flags, floor=floors)

    return stream.groupBy(by).applyInPandasWithState(solve, f"{fields}, onset boolean, floor double", "floor double, armed boolean", "append", "NoTimeout")
