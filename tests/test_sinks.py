import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from echofold.sinks import commits
from echofold.sinks.claims import AppendedIndex, ClaimLog
from echofold.sinks.commits import CommitLog, Leases, create_once, read_text, replace_json
from echofold.sinks.publish import TASK, ObjectStore, publish


def sha(x):
    return hashlib.sha256(x).hexdigest()


def task(k, cls, name, body, expected=None, size=None, source="computed-at-import"):
    return (cls, name, k, body, expected, size, source)


def tasks(spark, rows):
    return spark.createDataFrame([task(k, *r) for k, r in enumerate(rows)], TASK)


def told(run):
    return {r["ord"]: (r["outcome"], r["reason"], r["deduped"]) for r in run.outcomes.collect()}


def visible(store):
    return {(r["object_class"], r["logical_id"]): bytes(r["body"]) for r in store.objects().collect()}


def test_a_file_is_made_once(spark, tmp_path):
    path = f"{tmp_path}/x/a.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: create_once(spark, path, f"{k}" * 1000), range(8)))
    assert sum(made) == 1 and read_text(spark, path) == f"{made.index(True)}" * 1000
    assert commits.names(spark, f"{tmp_path}/x") == ["a.json"]


def test_json_is_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/y/state.json"
    for value in ({"a": 1}, {"b": [1, 2]}):
        replace_json(spark, path, value)
    assert read_text(spark, path) == '{"b": [1, 2]}' and commits.names(spark, f"{tmp_path}/y") == ["state.json"]


def test_one_commit_a_generation(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda k: log.commit(0, {"who": k}), range(6)))
    assert sum(won) == 1 and log.generation() == 1 and log.entries() == [{"who": won.index(True)}]
    assert log.commit(1, {"who": "next"}) and not log.commit(1, {"who": "late"})


def test_leases_run_out_and_fence(spark, tmp_path):
    leases = Leases(spark, f"{tmp_path}/leases")
    a = leases.acquire("run", "a", 10, now=100)
    assert a.epoch == 1 and leases.acquire("run", "b", 10, now=105) is None and leases.live(a, 105)
    b = leases.acquire("run", "b", 10, now=111)
    assert b.epoch == 2 and not leases.live(a, 105) and leases.live(b, 112)
    leases.release(b, 113)
    assert not leases.live(b, 113) and leases.acquire("run", "c", 10, now=113).epoch == 4


def test_outcomes_in_order(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    run = publish(store, tasks(spark, [
        ("raw", "a", b"one"), ("raw", "b", b"one"), ("raw", "a", b"one"), ("clip", "a", b"two", sha(b"two"), 3, "ledger.jsonl"),
        ("clip", "b", b"bad", sha(b"good"), 3, "index.jsonl"), ("clip", "c", b"bad", sha(b"good")), ("clip", "d", b"long", sha(b"long"), 9, "ledger.jsonl"), ("clip", "e", None), ("raw", "c", b""),
    ]))
    assert run.generation == 1 and told(run) == {
        0: ("published", None, False), 1: ("published", None, True), 2: ("replayed", None, True), 3: ("published", None, False),
        4: ("quarantined", "source_digest_mismatch", False), 5: ("quarantined", "readback_mismatch", False), 6: ("quarantined", "length_mismatch_on_digest_match", False),
        7: ("quarantined", "source_unreadable", False), 8: ("published", None, False),
    }
    assert visible(store) == {("raw", "a"): b"one", ("raw", "b"): b"one", ("clip", "a"): b"two", ("raw", "c"): b""}
    again = publish(store, tasks(spark, [("raw", "a", b"one"), ("clip", "z", b"new"), ("clip", "a", b"other"), ("clip", "y", b"bad", sha(b"x"), None, "ledger.jsonl"), ("raw", "d", b"two"), ("clip", "z", b"new")]))
    assert told(again) == {0: ("replayed", None, True), 1: ("published", None, False), 2: ("quarantined", "pointer_conflict", False), 3: ("deferred", "class_halted", False), 4: ("published", None, True), 5: ("deferred", "class_halted", False)}
    assert visible(store)[("clip", "a")] == b"two" and visible(store)[("clip", "z")] == b"new" and visible(store)[("raw", "d")] == b"two"
    third = publish(store, tasks(spark, [("raw", "a", b"changed"), ("raw", "n", b"n")]), resume=True)
    assert told(third) == {0: ("skipped_done", None, False), 1: ("published", None, False)}


def test_a_crash_before_the_commit_shows_nothing_and_is_made_good(spark, tmp_path):
    store, rows = ObjectStore(spark, f"{tmp_path}/s"), [("raw", "a", b"one"), ("raw", "b", b"two")]
    assert publish(store, tasks(spark, rows), fail_before_commit=True).generation is None
    assert visible(store) == {} and store.blobs().count() == 2
    run = publish(store, tasks(spark, rows))
    assert told(run) == {0: ("published", None, True), 1: ("published", None, True)} and visible(store) == {("raw", "a"): b"one", ("raw", "b"): b"two"}
    assert store.blobs().count() == 2


def test_a_corrupt_blob_is_never_pointed_at(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    spark.createDataFrame([(sha(b"one"), 3, b"oNe")], "digest string, bytes long, body binary").write.parquet(f"{store.root}/blobs/x")
    assert told(publish(store, tasks(spark, [("raw", "a", b"one"), ("raw", "b", b"two")]))) == {0: ("quarantined", "stored_blob_corrupt", False), 1: ("published", None, False)}


def test_late_writers_are_fenced(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    old = store.leases.acquire("import", "a", 10, now=0)
    new = store.leases.acquire("import", "b", 10, now=20)
    assert publish(store, tasks(spark, [("raw", "a", b"old")]), lease=old, now=21).aborted == "lease_fenced"
    assert publish(store, tasks(spark, [("raw", "a", b"new")]), lease=new, now=21).generation == 1 and visible(store) == {("raw", "a"): b"new"}


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    store = ObjectStore(spark, f"{tmp_path}/s")
    own = store.log.commit
    other = lambda planned_on, entry: own(planned_on, {"run": "other", "epoch": None}) and own(planned_on, entry)
    spark.createDataFrame([], "object_class string, logical_id string, digest string, bytes long, ord long").write.parquet(f"{store.root}/pointers/other")
    monkeypatch.setattr(store.log, "commit", other)
    assert publish(store, tasks(spark, [("raw", "a", b"x")])).aborted == "lost_generation" and visible(store) == {}


def test_an_empty_run(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    assert publish(store, spark.createDataFrame([], TASK)).generation == 1 and visible(store) == {}


def test_concurrent_claims_are_disjoint(spark, tmp_path):
    ledger = spark.createDataFrame([(f"r{k:03d}", float(k % 7), k) for k in range(60)] + [("later", 1e9, 0)], "record_id string, next_attempt_at double, k long")
    log = ClaimLog(spark, f"{tmp_path}/c")
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda w: [r["record_id"] for r in log.claim(ledger, w, 15, 60.0, 100.0).collect()], "abc"))
    assert [len(g) for g in got] == [15, 15, 15] and len({x for g in got for x in g}) == 45
    by_age = [f"r{k:03d}" for k in sorted(range(60), key=lambda k: (k % 7, k))]
    assert {x for g in got for x in g} == set(by_age[:45])
    rest = log.claim(ledger, "d", 100, 60.0, 100.0).collect()
    assert {r["record_id"] for r in rest} == set(by_age[45:])


def test_a_claim_that_ran_out_cannot_finish(spark, tmp_path):
    ledger = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "record_id string, next_attempt_at double")
    log = ClaimLog(spark, f"{tmp_path}/c")
    first = log.claim(ledger, "w1", 2, 10.0, 100.0)
    assert log.claim(ledger, "w2", 2, 10.0, 105.0).count() == 0
    second = log.claim(ledger, "w2", 1, 10.0, 111.0)
    result = lambda c: c.select("record_id", "token", F.lit("done").alias("state"))
    late = {r["record_id"]: r["accepted"] for r in log.finish(result(first), 112.0).collect()}
    assert late == {"a": False, "b": False}
    assert [(r["record_id"], r["accepted"]) for r in log.finish(result(second), 113.0).collect()] == [("a", True)]
    free = log.claim(ledger, "w3", 5, 10.0, 130.0)
    assert [r["record_id"] for r in free.collect()] == ["b"]
    log.finish(free.select("record_id", "token", F.lit("free").alias("state")), 131.0)
    assert [r["record_id"] for r in log.claim(ledger, "w4", 5, 10.0, 132.0).collect()] == ["b"]


def test_an_index_takes_a_batch_once(spark, tmp_path):
    index, schema = AppendedIndex(spark, f"{tmp_path}/i"), "key string, v long"
    assert index.rows(schema).count() == 0
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert index.append("1", batch(("a", 1), ("b", 1))) and index.append("2", batch(("a", 5), ("a", 3))) and not index.append("1", batch(("a", 9)))
    assert sorted((r["key"], r["v"]) for r in index.current(schema, "key", "v").collect()) == [("a", 5), ("b", 1)] and index.rows(schema).count() == 4


@pytest.mark.parametrize("n", [5])
def test_concurrent_appends_all_arrive(spark, tmp_path, n):
    index = AppendedIndex(spark, f"{tmp_path}/i")
    with ThreadPoolExecutor(n) as pool:
        assert all(pool.map(lambda k: index.append(str(k), spark.createDataFrame([(str(k), k)], "key string, v long")), range(n)))
    assert index.rows("key string, v long").count() == n
