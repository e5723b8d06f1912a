import gzip
import json
import os
import random

import pytest

from echofold.sources import ranges
from echofold.sources.ranges import SourceRotated, cut, deferred_tails, freeze_all, frozen_lines, frozen_stream, read_range


def landed(folder, day, node, lines, tail=b"", name="a.jsonl"):
    at = folder / f"day={day}" / f"node={node}"
    at.mkdir(parents=True, exist_ok=True)
    with open(at / name, "ab") as f:
        f.write(b"".join(x + b"\n" for x in lines) + tail)
    return str(at / name)


def made(n, seed=1):
    r = random.Random(seed)
    return [json.dumps({"i": i, "x": "é" * r.randint(0, 40)}, ensure_ascii=False).encode() for i in range(n)]


def test_every_line_once_in_any_ranges(spark, tmp_path):
    lines = made(10_000)
    path = landed(tmp_path, "2026-01-01", "n1", lines, tail=b'{"i": 10000, "x": "to')
    size = os.path.getsize(path)
    for n_ranges in (1, 7):
        df = frozen_lines(spark, str(tmp_path), -(-size // n_ranges))
        assert df.rdd.getNumPartitions() == n_ranges
        got = df.collect()
        starts = [0]
        for x in lines[:-1]:
            starts.append(starts[-1] + len(x) + 1)
        assert sorted((r["start"], r["line"]) for r in got) == [(k, x.decode()) for k, x in zip(starts, lines)]
        assert [json.loads(r["line"])["i"] for r in sorted(got, key=lambda r: r["start"])] == list(range(10_000))
    assert {(r["day"], r["node"]) for r in got} == {("2026-01-01", "n1")}
    tails = deferred_tails(spark, str(tmp_path)).collect()
    assert [(r["end"], r["deferred_bytes"]) for r in tails] == [(size - 21, 21)]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_ranges_and_blocks_of_any_size(tmp_path, monkeypatch, block):
    monkeypatch.setattr(ranges, "_BLOCK", block)
    lines = [b"a", b"", b"bcd", b"  ", b"e" * 20, b"\xff\xfe", b"z"]
    path = landed(tmp_path, "d", "n", lines, tail=b"torn")
    at, want = 0, []
    for x in lines:
        if x.strip():
            want.append((at, x.decode("utf-8", "replace")))
        at += len(x) + 1
    _, files = freeze_all(str(tmp_path))
    for size in range(1, at + 3):
        parts = cut(files[0], 0, size)
        got = [(s, x) for p in parts for b in read_range(path, p) for s, x in zip(b.column("start").to_pylist(), b.column("line").to_pylist())]
        assert got == want


def test_days_and_nodes_pick_files(spark, tmp_path):
    for day in "12":
        for node in "ab":
            landed(tmp_path, day, node, [f"{day}{node}".encode()])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = frozen_lines(spark, str(tmp_path)).where("day = '1' and node in ('a', 'c') and line <> 'x'")
        assert [r["line"] for r in df.collect()] == ["1a"] and df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {r["line"] for r in frozen_lines(spark, str(tmp_path)).where("day = '2'").collect()} == {"2a", "2b"}


def test_compressed_files_are_read_by_all_their_members(spark, tmp_path):
    for part in (b"one\ntwo\n", b"three\nto"):
        with gzip.open(tmp_path / "a.jsonl.gz", "ab") as f:
            f.write(part)
    assert [r["line"] for r in frozen_lines(spark, str(tmp_path)).collect()] == ["one", "two", "three"]


def test_files_without_a_whole_line(spark, tmp_path):
    landed(tmp_path, "d", "n", [], tail=b"torn")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x\n")
    assert frozen_lines(spark, str(tmp_path)).count() == 0
    assert sorted(r["deferred_bytes"] for r in deferred_tails(spark, str(tmp_path)).collect()) == [0, 4]


def test_a_rotated_file_is_refused(tmp_path):
    path = landed(tmp_path, "d", "n", [b"first", b"second"])
    part = cut(freeze_all(str(tmp_path))[1][0], 0, 100)[0]
    landed(tmp_path, "d", "n", [b"third"])
    assert [x for b in read_range(path, part) for x in b.column("line").to_pylist()] == ["first", "second"]
    with open(path, "wb") as f:
        f.write(b"other\nbytes\nfrom another file\n")
    with pytest.raises(SourceRotated):
        list(read_range(path, part))
    with open(path, "wb") as f:
        f.write(b"first\n")
    with pytest.raises(SourceRotated):
        list(read_range(path, part))


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")

    def run():
        q = frozen_stream(spark, str(logs), 200).select("node", "line").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    lines = [x.decode() for x in made(60)]
    landed(logs, "d", "a", [x.encode() for x in lines[:20]], tail=lines[20].encode()[:5])
    assert run() == sorted(lines[:20])
    assert run() == sorted(lines[:20])
    landed(logs, "d", "a", [lines[20].encode()[5:], *(x.encode() for x in lines[21:40])])
    landed(logs, "d", "b", [x.encode() for x in lines[40:]])
    assert run() == sorted(lines)
    with open(logs / "day=d/node=a/a.jsonl", "wb") as f:
        f.write(b"rotated\n")
    with pytest.raises(Exception, match="SourceRotated"):
        run()
    assert sorted(r["line"] for r in spark.read.parquet(out).collect()) == sorted(lines)


def test_messages_keep_their_reasons(spark):
    import base64

    from echofold.sources.records import sketch_records

    v1 = (999_600).to_bytes(4, "little") + (-40).to_bytes(2, "little", signed=True) + (7).to_bytes(2, "little") + bytes([2, 3]) + (0x1001).to_bytes(2, "little") + bytes([1, 255, 3, 4, 5, 6])
    b64 = lambda x: base64.b64encode(x).decode()
    message = lambda **k: json.dumps({"topic": "ears/n7/sketch", "payload": k})
    lines = [
        message(sketch_b64=b64(v1), ts_utc_ms=5000, bands=2, layout="fixed", fs=8000.0), message(sketch_b64=b64(v1 + b"pad")), message(sketch_b64=b64(v1), frames=4), message(sketch_b64=b64(v1), layout="nyquist"),
        message(sketch_b64=b64(v1[:15])), message(sketch_skipped="busy"), message(), message(sketch_b64="*"), "{torn", json.dumps({"node_id": "me", "sketch_b64": b64(v1)}),
    ]
    rows = sketch_records(spark.createDataFrame([(f"f{k}", None, x) for k, x in enumerate(lines)], "path string, day string, line string")).collect()
    by = {int(r["path"][1:]): r for r in rows}
    assert [by[k]["reason"] for k in range(10)] == ["admitted", "admitted", "frames_disagree", "layout_disagrees", "unrecognised_frame", "phone_skipped", "no_sketch_b64", "bad_base64", "bad_json", "admitted"]
    first = by[0]
    assert (first["node"], first["version"], first["bands"], first["frames"], first["layout"], first["retrigger"], first["ref_db"], first["peak"], first["q"]) == ("n7", 1, 2, 3, "fixed", True, -10.0, 7, [1, -1, 3, 4, 5, 6])
    # 5.000 s rounded and 0.9996 s within a second: the second before.
    assert first["utc_us"] == 4_999_600 and (first["fs_hz"], first["fs_from"]) == (8000.0, "json") and by[1]["utc_us"] is None
    assert by[9]["node"] == "me" and by[2]["q"] is None


def test_a_source_must_be_given():
    from echofold.sources.records import bridge_rows

    with pytest.raises(ValueError):
        bridge_rows()
