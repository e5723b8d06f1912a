import json
import math
import random

import pytest
from pyspark.sql import functions as F

from echofold.streaming.tripwire import COLUMNS, Tripwire, band_level, silence_stream, silences

KINDS = "perimeter string, t double, kind string, name string, value double, x double, y double, z double"
PLACES = {"a": (0.0, 0.0, 0.0), "b": (30.0, 40.0, 0.0), "c": (0.0, 10.0, 0.0)}


def levels(perimeter, start, stop, db, mics="abc", step=0.05):
    n = round((stop - start) / step)
    return [(perimeter, round(start + k * step, 4), "level", m, db, *PLACES[m]) for k in range(n) for m in mics]


def chorus(perimeter="p", at=20.0, impact=True, mics="ab", lag=0.0):
    """A steady chorus in which some microphones fall silent for two seconds."""
    rows = []
    for m in "abc":
        begin = at + (lag if m == "b" else 0.0)
        if m in mics:
            rows += levels(perimeter, 0.0, begin, -20.0, m) + levels(perimeter, begin, at + 2.0, -35.0, m) + levels(perimeter, at + 2.0, at + 4.0, -20.5, m)
        else:
            rows += levels(perimeter, 0.0, at + 4.0, -20.0, m)
    return rows + ([(perimeter, at - 0.1, "impact", "s", None, None, None, None)] if impact else [])


def told(df):
    return sorted((r["perimeter"], r["outcome"], r["onset_s"], r["recovered_s"], None if r["tau_s"] is None else round(r["tau_s"], 6), None if r["drop_db"] is None else round(r["drop_db"], 6), tuple(r["mics"] or ()), r["perimeter_m"], r["velocity_mps"], r["n_impacts"], r["confidence"]) for r in df.collect())


def test_a_silence_of_two_microphones(spark):
    rows = chorus(lag=0.05)
    random.Random(1).shuffle(rows)
    (event,) = told(silences(spark.createDataFrame(rows, KINDS)))
    # Silent from 20 s, back after 2 s, which is the fraction 1 - 1/e of the way: one time constant.
    assert event[:4] == ("p", "silenced", 20.0, 22.0) and event[4] == pytest.approx(1.975) and event[5] == 15.0
    assert event[6:] == (("a", "b"), 50.0, pytest.approx(1000.0), 1, 1.0)
    (quiet,) = told(silences(spark.createDataFrame(chorus(impact=False), KINDS)))
    assert quiet[9:] == (0, 0.75) and quiet[8] is None


def test_what_is_no_silence(spark):
    one = chorus("one", mics="a")
    slow = [("slow", round(k * 0.5, 3), "level", m, -20.0 if k < 40 else -35.0, 0.0, 0.0, 0.0) for k in range(80) for m in "ab"]
    lasting = [r for r in chorus("lasting") if r[1] < 22.0]
    apart = chorus("apart", lag=0.5)
    assert told(silences(spark.createDataFrame(one + slow + lasting + apart, KINDS))) == []


def test_many_perimeters_at_once_are_independent(spark):
    rows = [r for k in range(7) for r in chorus(f"p{k}", at=5.0 + k)]
    got = told(silences(spark.createDataFrame(rows, KINDS).repartition(3)))
    assert [(e[0], e[2]) for e in got] == [(f"p{k}", 5.0 + k) for k in range(7)]


def test_rows_that_say_nothing(spark):
    rows = chorus() + [("p", 3.0, "level", "a", math.nan, None, None, None), ("p", 4.0, "level", "a", None, None, None, None), ("p", None, "level", "a", 1.0, None, None, None), (None, 1.0, "level", "a", 1.0, None, None, None)]
    got = silences(spark.createDataFrame(rows, KINDS)).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in got} == {"silenced": 1, "not_finite": 3}
    assert silences(spark.createDataFrame([], KINDS)).count() == 0


def test_limits_of_the_parameters():
    for bad in ({"drop_db": 5.0}, {"drop_db": 13.0}, {"tau_s": 0.0}, {"recovery": 1.0}, {"onset_s": 0.0}):
        with pytest.raises(ValueError):
            Tripwire(**bad)


@pytest.mark.parametrize("cuts", [(400, 700), (403, 1262)])
def test_a_stream_in_pieces_equals_the_batch(spark, tmp_path, cuts):
    """Pieces that end within a frame, too; the last frame ends with the next one."""
    rows = sorted(chorus("p") + chorus("q", at=9.0, lag=0.05), key=lambda r: (r[1], r[2], r[3]))
    rows += [(p, 100.0, "level", "a", -20.0, None, None, None) for p in "pq"]
    want = told(silences(spark.createDataFrame(rows, KINDS)))
    assert len(want) == 2
    for k, part in enumerate((rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :])):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = silence_stream(spark.readStream.schema(KINDS).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert told(spark.read.parquet(str(tmp_path / "out"))) == want


def test_a_stream_refuses_times_that_go_back(spark, tmp_path):
    for part in (levels("p", 0.0, 2.0, -20.0, "a"), levels("p", 1.0, 1.1, -20.0, "a")):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        silence_stream(spark.readStream.schema(KINDS).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["time_went_back"] * 2


def test_a_silent_perimeter_ends_by_event_time(spark, tmp_path):
    """Its last frame closes the silence when the watermark has passed it for long enough."""
    rows = [r for r in chorus("p") if r[1] <= 22.0]
    later = levels("q", 500.0, 500.2, -20.0, "a")
    kinds = f"{KINDS}, ts timestamp"
    for k, part in enumerate((rows, later, levels("q", 501.0, 501.2, -20.0, "a"), levels("q", 502.0, 502.1, -20.0, "a"))):
        spark.createDataFrame(part, KINDS).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
        silence_stream(stream, idle_s=60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["outcome"] == "silenced"]
    assert [(r["perimeter"], r["onset_s"], r["recovered_s"]) for r in got] == [("p", 20.0, 22.0)]


def test_levels_of_spectra(spark):
    df = spark.createDataFrame([([1000.0, 5000.0, 6000.0], [1.0, 0.5, 0.5]), ([1.0], [1.0]), ([5000.0], [1.0, 2.0]), ([5000.0], [-1.0])], "f array<double>, p array<double>")
    got = [r[0] for r in df.select(band_level(F.col("f"), F.col("p"), 4000.0, 7000.0)).collect()]
    assert got[0] == pytest.approx(0.0) and got[1:3] == [None, None] and got[3] == pytest.approx(-200.0)


def test_the_state_is_small():
    """Hours of levels leave an average for each microphone and the last frame."""
    import pandas as pd

    state = None
    for k in range(20):
        part = pd.DataFrame(levels("p", 100.0 * k, 100.0 * k + 50, -20.0) + [("p", 100.0 * k + 1, "impact", "s", None, None, None, None)], columns=COLUMNS).sort_values("t", kind="stable")
        state, _ = Tripwire().step(state, part.astype(object).where(part.notna(), None))
    assert len(json.dumps(state)) < 2000
