import json
import random

import pytest
from pyspark.sql import functions as F

from echofold.sinks.buffer import FrameBuffer, pruned, route
from echofold.sources.annotations import annotation_items, predictions, stored_clips, tag_rows

KINDS = "t double, frame binary"


def rows(spark, *times):
    return spark.createDataFrame([(float(t), b"x" * n) for t, n in times], KINDS)


def told(buffer, n):
    return sorted((r["t"], r["route"], r["late"]) for r in buffer.flushed(n).collect())


def test_routes_by_length(spark):
    got = spark.createDataFrame([(b"x" * n,) for n in (14, 172, 173, 0, 15)] + [(None,)], "frame binary").select(route(F.col("frame"))).collect()
    assert [r[0] for r in got] == ["status", "sketch", "sketch_tagged", "refused", "refused", "refused"]


def test_each_row_is_in_one_flush(spark, tmp_path):
    buffer = FrameBuffer(spark, str(tmp_path / "b"), KINDS)
    assert buffer.ingest(rows(spark, (1, 14), (5, 172), (9, 20)), 0) and not buffer.ingest(rows(spark, (1, 14)), 0)
    assert buffer.flush(5.0) == 1
    buffer.ingest(rows(spark, (2, 14), (5, 173), (6, 14)), 1)
    assert buffer.flush(7.0) == 2 and buffer.flush(7.0) == 3
    buffer.ingest(rows(spark, (1, 14)), 2)
    assert buffer.flush(100.0) == 4
    assert told(buffer, 1) == [(1.0, "status", False), (5.0, "sketch", False)]
    assert told(buffer, 2) == [(2.0, "status", True), (5.0, "sketch_tagged", True), (6.0, "status", False)]
    assert told(buffer, 3) == [] and told(buffer, 4) == [(1.0, "status", True), (9.0, "refused", False)]
    with pytest.raises(ValueError):
        buffer.flush(99.0)
    # Another process reads the same flushes again.
    assert told(FrameBuffer(spark, str(tmp_path / "b"), KINDS), 2) == told(buffer, 2)


def test_flushes_of_a_stream(spark, tmp_path):
    buffer, source = FrameBuffer(spark, str(tmp_path / "b"), KINDS), str(tmp_path / "in")
    for k in range(3):
        rows(spark, *[(10 * k + j, 14) for j in range(4)]).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KINDS).parquet(source)
        stream.writeStream.foreachBatch(buffer.ingest).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        buffer.flush(10.0 * k + 1)
    assert [[r[0] for r in told(buffer, n)] for n in (1, 2, 3)] == [[0.0, 1.0], [2.0, 3.0, 10.0, 11.0], [12.0, 13.0, 20.0, 21.0]]


@pytest.mark.parametrize("share", [0.0, 0.37, 1.0])
def test_pruning_stops_at_the_cap(spark, share):
    r = random.Random(8)
    index = [(f"k{i}", None if r.random() < 0.2 else r.uniform(0, 9e5), r.uniform(0, 9e5), r.choice([None, 0, 10, 500])) for i in range(300)]
    total = sum(x[3] or 0 for x in index)
    most, held, want = int(total * share), total, {}
    for key, t, mtime, size in sorted(index, key=lambda x: (x[1] is not None, x[1] if x[1] is not None else x[2], x[0])):
        want[key] = held > most
        held -= (size or 0) if want[key] else 0
    got = pruned(spark.createDataFrame(index, "clip_key string, t double, mtime double, bytes long"), most)
    assert {x["clip_key"]: x["pruned"] for x in got.collect()} == want


def lines(spark, *objects):
    return spark.createDataFrame([("f", x if isinstance(x, str) else json.dumps(x)) for x in objects], "path string, line string")


def test_predictions_of_all_shapes(spark):
    shapes = [
        {"scores": [{"label": "a", "score": 0.1}, {"name": "b", "prob": 0.9}, {"display_name": "c", "p": 0.5}, {"common_name": "d"}, {"x": 1}]},
        {"top_scores": {"a": 0.2, "b": 0.7}}, {"predictions": [["a", 0.3], ["b", "0.4"], ["", 1.0], [5]]}, {"top": {"label": "t", "score": 0.6}}, {"scores": [], "top1": {"name": "u"}},
        {"scores": [{"label": str(k), "score": k / 10} for k in range(8)]}, {"scores": "no"}, {}, "{torn",
    ]
    got = [[(p["label"], p["score"]) for p in r[0] or []] for r in lines(spark, *shapes).select(predictions(F.col("line"))).collect()]
    assert got[0] == [("d", None), ("b", 0.9), ("c", 0.5), ("a", 0.1)] and got[1] == [("b", 0.7), ("a", 0.2)]
    assert [x for x in got[2] if x[0] in "ab"][:2] == [("b", 0.4), ("a", 0.3)]
    assert got[3] == [("t", 0.6)] and got[4] == [("u", None)] and [x[0] for x in got[5]] == ["7", "6", "5", "4", "3"] and got[6:] == [[], [], []]


def test_clips_and_lanes(spark):
    index = lines(spark, {"clip_key": "a", "outcome": "stored", "path": "x/a.wav", "at": 1}, {"key": "a", "outcome": "stored", "path": "y/a.wav", "at": 2}, {"clip_key": "b", "outcome": "failed", "path": "b.wav"}, {"clip_key": "c", "outcome": "stored", "path": "../c.wav"}, {"clip_key": "d", "outcome": "stored", "path": "/d.wav"}, {"clip_key": "e", "outcome": "stored", "path": "e.wav"}, {"clip_key": "", "outcome": "stored", "path": "f.wav"}, "{")
    assert sorted(tuple(r) for r in stored_clips(index).collect()) == [("a", "y/a.wav"), ("e", "e.wav")]
    one = lines(spark, {"clip_key": "a", "model": {"name": "m", "version": "2"}, "scores": {"dog": 0.4}}, {"key": "a", "model_name": "n", "scores": {"cat": 0.8}}, {"scores": {"x": 1}}, {"clip_key": "zz", "scores": {"x": 1}})
    two = lines(spark, {"clip_key": "a", "lane": "bird", "scores": {"wren": 0.6}})
    assert sorted((r["clip_key"], r["model"], r["version"]) for r in tag_rows(one, "l").collect()) == [("a", "m", "2"), ("a", "n", None), ("zz", "model", None)]
    got = {r["clip_key"]: r for r in annotation_items(index, {"l": one, "b": two}).collect()}
    assert [(t["lane"], t["model"]) for t in got["a"]["tags"]] == [("b", "bird"), ("l", "m"), ("l", "n")] and (got["a"]["top"], got["a"]["top_score"]) == ("cat", 0.8)
    assert got["e"]["tags"] is None and got["e"]["top"] is None
