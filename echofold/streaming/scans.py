"""State machines over the rows of a key in order, in bounded memory: on a batch and on a stream.

On a batch the keys are dealt to tasks, and each task goes through its rows sorted by key and order, a piece of an Arrow batch at a time; only the state of one key is held.
On a stream each key's state is Spark's. A machine is asked for rows of one key in order and gives rows back, and tells its state as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A machine: ``step(state, rows) -> (state, rows out)`` for rows of one key in order; ``end(state) -> rows out`` when there are no more.
Step = Callable[[dict | None, pd.DataFrame], tuple[dict, pd.DataFrame]]


def scan_batch(rows: DataFrame, key: str, order: list[str], step: Step, schema: str, end: Callable[[dict], pd.DataFrame] | None = None) -> DataFrame:
    """All rows through the machine. A null key is one of its own. ``schema`` is that of the rows out."""
    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            # Rows of a key are together; where a batch is cut, its state is carried on.
            names = batch[key].astype(object).where(batch[key].notna(), None)
            starts = (names != names.shift()) & ~(names.isna() & names.shift().isna())
            starts.iloc[:1] = True
            for _, part in batch.groupby(starts.cumsum().to_numpy(), sort=False):
                name = names.loc[part.index[0]]
                if state is None or name != at:
                    if state is not None and end is not None:
                        yield end(state)
                    at, state = name, None
                state, out = step(state, part)
                yield out
        if state is not None and end is not None:
            yield end(state)

    return dealt.mapInPandas(run, schema)


def scan_stream(stream: DataFrame, key: str, order: list[str], step: Step, schema: str, end: Callable[[dict], pd.DataFrame] | None = None, idle_s: float | None = None, time: str | None = None) -> DataFrame:
    """The same on a stream: the rows of a micro-batch are taken in order after those of earlier ones.

    With ``idle_s`` and ``time`` (a timestamp with a watermark) a key that has been silent for so long by event time gives what ``end`` says, and its state is removed.
    """

    def solve(names: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = json.loads(state.get[0])
            state.remove()
            if end is not None:
                yield end(held)
            return
        part = pd.concat(list(batches)).sort_values(order, kind="stable")
        held, out = step(json.loads(state.get[0]) if state.exists else None, part)
        state.update((json.dumps(held),))
        if idle_s is not None:
            latest = int(part[time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(idle_s * 1000))
        yield out

    return stream.groupBy(key).applyInPandasWithState(solve, schema, "state string", "append", "NoTimeout" if idle_s is None else "EventTimeTimeout")
