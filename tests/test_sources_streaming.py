import base64
import json

from pyspark.sql import functions as F

from echofold.sources import logs
from echofold.streaming import horizons as H


def lines_of(spark, tmp_path, text, name="a.jsonl"):
    folder = tmp_path / "day=2026-01-02"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return logs.text_lines(spark, str(tmp_path))


def test_torn_line_is_kept_with_a_reason(spark, tmp_path):
    lines = lines_of(spark, tmp_path, '{"a": 1}\n\n[1]\n{"a": 2, "b"')
    rows = logs.json_rows(lines, "a int")
    assert sorted((r["reason"], r["row"] and r["row"]["a"], r["day"]) for r in rows.collect()) == sorted(
        [("admitted", 1, "2026-01-02"), ("bad_json", None, "2026-01-02"), ("bad_json", None, "2026-01-02")], key=str
    )
    assert logs.count_lines(spark, str(tmp_path)).first()["n_lines"] == 3


def test_last_line_wins(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 3, "z"), ("m", 1, "w")], "key string, at int, v string")
    assert sorted(logs.last_line_wins(df, "key", ["at"]).collect()) == [("k", 2, "y", 1), ("m", 1, "w", 0)]


def test_sensor_messages(spark, tmp_path):
    good = base64.b64encode(b"abc").decode()
    messages = [
        {"topic": "t/n1/s", "payload": {"sketch_b64": good, "ts_utc_ms": 5}},
        {"node_id": "n2", "payload": {"sketch_skipped": True}},
        {"topic": "t", "payload": {"node_id": "n3"}},
        {"topic": "t/n4/s", "sketch_b64": good},
        {"topic": "t/n5/s", "payload": {"sketch_b64": "*"}},
    ]
    lines = lines_of(spark, tmp_path, "\n".join(map(json.dumps, messages)) + "\nnot json")
    got = {(r["node"], r["node_from"], bytes(r["frame"]) if r["frame"] is not None else None, r["reason"]) for r in logs.sensor_messages(lines).collect()}
    assert got == {
        ("n1", "topic", b"abc", "admitted"),
        ("n2", "topic", None, "phone_skipped"),
        ("n3", "payload", None, "no_sketch_b64"),
        ("n4", "topic", b"abc", "admitted"),
        ("n5", "topic", None, "bad_base64"),
        ("?", "payload", None, "bad_json"),
    }


def test_csv_generations(spark):
    df = spark.createDataFrame([("f", 1, "a, b"), ("f", 2, "1,2"), ("f", 3, "1"), ("g", 1, "n,a"), ("g", 2, " 7"), ("h", 1, "q"), ("h", 2, "1")], "path string, line_no int, line string")
    got = logs.csv_generations(df, {"G1": (["a", "b"], ["a", "b"]), "G2": (["n", "a"], ["a"])}).collect()
    assert {(r["path"], r["line_no"], r["generation"], str(r["cells"]), r["reason"]) for r in got} == {
        ("f", 2, "G1", "{'a': '1', 'b': '2'}", "admitted"),
        ("f", 3, "G1", "None", "row_width_1_expected_2"),
        ("g", 2, "G2", "{'a': '7'}", "admitted"),
        ("h", 2, None, "None", "unknown_header"),
    }


def test_task_states(spark):
    log = [("a", "claim", None, 1), ("a", "failed", False, 2), ("a", "published", None, 3), ("b", "deferred", None, 4), ("c", "failed", True, 5), ("d", "failed", None, 6)]
    got = logs.task_states(spark.createDataFrame(log, "task_id string, type string, retryable boolean, seq int"))
    assert {tuple(r) for r in got.collect()} == {("a", True, True, False, False), ("b", False, False, True, False), ("c", False, False, False, False), ("d", False, False, False, True)}


def test_aircraft_states(spark, tmp_path):
    doc = {"now": 100.0, "aircraft": [{"hex": " AB1 ", "lat": 1, "lon": 2, "altitude": 300, "seen": 2.5}, {"hex": "c", "alt_baro": 1}, {"hex": "d", "lat": 1, "lon": 1, "alt_baro": "ground"}]}
    rows = logs.aircraft_states(lines_of(spark, tmp_path, json.dumps(doc) + '\n{"now"')).drop("path").collect()
    assert [tuple(r) for r in rows] == [("ab1", None, 1.0, 2.0, 300.0, 0.0, 0.0, 0.0, 97.5)]


def test_horizons(spark):
    df = spark.createDataFrame([(None, False), (10, False), (7200, False), (259200, False), (259201, True), (259201, False)], "age int, emitted boolean")
    got = [r[0] for r in df.select(H.horizon_class(F.col("age"), F.col("emitted"))).collect()]
    assert got == ["unanchored", "pending_settle", "admitted", "admitted", "lookback_emitted", "lookback_lost"]
    late = spark.createDataFrame([(None,), (0,), (3600,), (3601,)], "s int").select(H.late_class(F.col("s")))
    assert [r[0] for r in late.collect()] == ["missing", "on_time", "late_arrival", "missing"]


def test_stream_agrees_with_batch_and_replay_adds_nothing(spark, tmp_path):
    rows = [(f"k{i % 7}", f"2026-01-01 0{i % 3}:00:00", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t string, node int").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    counts = H.tumbling_counts(stream, "t", "1 hour", ["node"]).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert sorted(spark.table("tumbling").collect()) == sorted(H.tumbling_counts(df, "t", "1 hour", ["node"]).collect())

    out = str(tmp_path / "out")
    for attempt in ("a", "b"):
        sink = H.distinct_events(stream, ["k"], "t").writeStream.foreachBatch(H.append_new(out, "k")).option("checkpointLocation", str(tmp_path / attempt)).trigger(availableNow=True).start()
        sink.awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == sorted({r[0] for r in rows})


def test_level_gate_on_a_stream_agrees_with_the_batch(spark, tmp_path):
    """A channel's floor goes on from one micro-batch to the next."""
    import random

    from echofold.streaming import gates

    r = random.Random(2)
    rows = [(i % 3, i, r.choice([1.0, 1.2, 0.9, 9.0, 30.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "node int, seq int, x double")
    for k in range(3):
        df.where(f"seq div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(gates.level_onsets(df, "node", ["seq"], "x").collect())
    assert any(x["onset"] for x in want)
    # One file a batch, in the order in which they were written.
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = gates.level_onset_stream(stream, "node", ["seq"], "x")
    q = out.writeStream.outputMode("append").format("memory").queryName("onsets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("onsets").collect()) == want


def test_salvaged_rows_and_tails(spark):
    pages = spark.createDataFrame([("a", '[{"i": 1}, {"i": 2}]'), ("b", '{"cursor": 3, "detections": [{"i": 3}]}'), ("c", '[{"i": 4}, {"i": 5'), ("d", "")], "path string, line string")
    assert sorted((r["path"], r["page"], r["row"]["i"]) for r in logs.salvaged_rows(pages, "i int").collect()) == [("a", "array", 1), ("a", "array", 2), ("b", "envelope", 3), ("c", "torn", 4)]
    tails = spark.createDataFrame([("f", 1, "9,9,9"), ("f", 2, "1,2"), ("f", 3, "3,4"), ("f", 4, "5")], "path string, line_no int, line string")
    out = logs.tail_rows(tails, "line_no", F.lit(True)).collect()
    assert sorted((r["line_no"], r["reason"]) for r in out) == [(1, "partial_first_line"), (2, "admitted"), (3, "admitted"), (4, "row_width_1_expected_2")]


def test_field_log_raises_on_a_bad_line(spark):
    import pytest

    lines = spark.createDataFrame([('{"name": "a", "utc": "1", "e_m": 1, "n_m": 2}',), ("{",)], "line string")
    assert logs.latest_placements(lines.where("line like '%name%'")).count() == 1
    with pytest.raises(Exception):
        logs.latest_placements(lines).collect()
