"""Streams with clocks: order, lateness, time to live, silence, count or time, and replayed batches."""

import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.operators import logs
from textquarry.streaming import once, stateful, timed


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


def started(spark, tmp_path, schema, build, out, **trigger):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    return build(source).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(**trigger).start()


def whole(spark, tmp_path, batches, schema, build):
    """Rows of a stream on event time over files, one a batch."""
    out = []
    for k, rows in enumerate(batches):
        put(tmp_path / "in", f"{k:03}", rows)
        time.sleep(0.02)  # files are taken by their time
    run = started(spark, tmp_path, schema, build, out, availableNow=True)
    run.awaitTermination(100)
    assert run.exception() is None and not run.isActive
    return out


def until(run, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end and run.isActive:
        time.sleep(0.1)
    assert run.exception() is None and done()


def at(minute, second=0):
    return f"2024-01-01T{minute // 60:02}:{minute % 60:02}:{second:02}Z"


TASK = "task_id string, event_id long, ts timestamp, status string"


def test_a_silent_task_turns_dead_and_is_removed(spark, tmp_path):
    event = lambda t, i, m, s: {"task_id": t, "event_id": i, "ts": at(m), "status": s}
    batches = [[event("a", 1, 0, "QUEUED"), event("b", 2, 1, "QUEUED")], [event("b", 4, 3, "SUCCESS"), event("b", 3, 2, "STARTED"), event("a", 5, 4, "STARTED")], [event("c", 6, 20, "QUEUED")], [event("c", 7, 70, "STARTED")], [event("d", 8, 200, "SUCCESS")]]
    out = whole(spark, tmp_path, batches, TASK, lambda s: timed.task_clock(s, 300, 3600, "10 minutes"))
    by = {t: [r.status for r in sorted((r for r in out if r.task_id == t), key=lambda r: r.version)] for t in "abcd"}
    assert by == {"a": ["QUEUED", "STARTED", "DEAD", "REMOVED"], "b": ["QUEUED", "SUCCESS", "REMOVED"], "c": ["QUEUED", "STARTED", "DEAD", "REMOVED"], "d": ["SUCCESS"]}
    b = next(r for r in out if r.task_id == "b" and r.status == "SUCCESS")
    assert (b.started_at, b.completed_at) == (1704067320000000, 1704067380000000)


def test_the_sweep_of_a_stream_equals_the_batch_sweep(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [{"task_id": f"t{k % 25}", "event_id": k, "ts": at(rng.randrange(0, 600), k % 60), "status": rng.choice(["QUEUED", "STARTED", "SUCCESS", "FAILURE"])} for k in range(120)] + [{"task_id": "end", "event_id": 999, "ts": at(700), "status": "QUEUED"}]
    batches = [rows[k::4] for k in range(4)]  # out of order across batches; the watermark waits
    changes = whole(spark, tmp_path, batches, TASK, lambda s: timed.task_clock(s, 3600, 18000, "12 hours"))
    # behind a watermark of 12 hours nothing is swept yet: the fold alone
    frame = spark.createDataFrame([(r["task_id"], r["event_id"], r["ts"], r["status"]) for r in rows], "task_id string, event_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {r.task_id: (r.status, r.started_at, r.completed_at) for r in logs.task_state(frame.withColumns({"stage": F.lit(""), "done": F.lit(0)})).select("task_id", "status", F.unix_micros("started_at").alias("started_at"), F.unix_micros("completed_at").alias("completed_at")).collect()}
    got = {r.task_id: (r.status, r.started_at, r.completed_at) for r in timed.newest_states(spark.createDataFrame(changes)).collect()}
    assert got == want


def test_a_stream_that_falls_silent_as_a_whole_is_swept_by_the_wall_clock(spark, tmp_path):
    out = []
    put(tmp_path / "in", "0", [{"task_id": "a", "event_id": 1, "ts": at(0), "status": "STARTED"}])
    run = started(spark, tmp_path, TASK, lambda s: timed.task_clock(s, 300, 10**9, wall_clock=True), out, processingTime="100 milliseconds")
    try:
        until(run, lambda: len(out) >= 2)
    finally:
        run.stop()
    assert [r.status for r in out] == ["STARTED", "DEAD"]


LOGIN = "user_id string, event_id long, ts timestamp, ok boolean"


def test_locks_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    event = lambda i, m, ok=False, u="u": {"user_id": u, "event_id": i, "ts": at(m), "ok": ok}
    # The success at minute 2 arrives two batches after the failures around it, and clears those before it.
    batches = [[event(1, 0), event(2, 1), event(4, 3)], [event(5, 4)], [event(3, 2, True), event(6, 5)], [event(7, 6), event(8, 200)], [event(99, 400, u="end")]]
    out = whole(spark, tmp_path, batches, LOGIN, lambda s: timed.locks(s, 3, 900, "30 minutes"))
    rows = [e for b in batches for e in b]
    frame = spark.createDataFrame([(r["user_id"], r["event_id"], r["ts"], r["ok"]) for r in rows], "user_id string, event_id long, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.user_id, r.event_id, r.failures) for r in logs.locked_logins(frame, 900, 3).collect()}
    assert {(r.user_id, r.event_id, r.failures) for r in out} == want == {("u", 6, 3), ("u", 7, 4)}


BATCH = "asset_id string, batch_index int, status string, total_batches int"


def test_completion_is_emitted_once_and_forgotten_after_its_time(spark, tmp_path):
    row = lambda i, s="corrected": {"asset_id": "a", "batch_index": i, "status": s, "total_batches": 2}
    out, source = [], tmp_path / "in"
    put(source, "0", [row(0), row(0)])
    run = started(spark, tmp_path, BATCH, lambda s: timed.completed_assets(s, ttl_s=8), out, processingTime="100 milliseconds")
    try:
        seen = lambda: sum(p["numInputRows"] for p in run.recentProgress)
        until(run, lambda: seen() == 2)
        put(source, "1", [row(1, "new")])
        put(source, "2", [row(1)])
        until(run, lambda: len(out) == 1)
        put(source, "3", [row(1), row(0)])
        until(run, lambda: seen() == 6)
        assert [(r.asset_id, r.batches) for r in out] == [("a", 2)]
        until(run, lambda: run.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)  # the time to live is over
    finally:
        run.stop()


ITEM = "stage string, id long, text string"


def test_a_lone_item_is_flushed_by_time_and_eight_go_together(spark, tmp_path):
    def judge(texts):
        if "boom" in texts:
            raise RuntimeError("no answer")
        return [t != "bad" for t in texts]

    out, source = [], tmp_path / "in"
    put(source, "0", [{"stage": "input", "id": 100, "text": "bad"}])
    run = started(spark, tmp_path, ITEM, lambda s: timed.judged_items(s, judge), out, processingTime="50 milliseconds")
    try:
        until(run, lambda: len(out) == 1)  # nothing else came: the timer
        assert (out[0].id, out[0].safe, out[0].batch_size) == (100, False, 1)
        put(source, "1", [{"stage": "output", "id": k, "text": "boom" if k == 9 else "bad" if k % 4 == 0 else "fine"} for k in range(19)] + [{"stage": "input", "id": 200, "text": None}])
        until(run, lambda: len(out) == 21)
    finally:
        run.stop()
    got = {r.id: r for r in out}
    assert Counter(r.batch_size for r in out if r.stage == "output") == {8: 16, 3: 3}
    assert all(got[k].safe is None for k in range(19) if any(got[k].id // 8 == 1 for _ in [0])) and all(got[k].safe is (k % 4 != 0) for k in (*range(8), 16, 17, 18))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    assert once.write_batch(rows, 0, path, "q") and once.write_batch(rows, 0, path, "other")
    rows.write.parquet(f"{path}/data/query=q/batch=1")  # the writer died before its commit
    assert once.committed(spark, path, rows.schema).count() == 4
    assert once.write_batch(rows.limit(1), 1, path, "q") and not once.write_batch(rows, 1, path, "q") and not once.write_batch(rows, 0, path, "q")
    assert once.committed(spark, path, rows.schema).count() == 5 and once.commits(spark, path).count() == 3
    assert once.committed(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_ingestion_survives_a_kill_between_write_and_checkpoint(spark, tmp_path):
    path, source, schema = str(tmp_path / "table"), tmp_path / "in", "path string, text string"
    put(source, "0", [{"path": "a", "text": "word " * 400}])

    def run(break_at=None):
        def each(batch, number):
            once.write_batch(batch, number, path, "ingest")
            if number == break_at:
                raise RuntimeError("killed after the write")

        stream = stateful.ingested(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(90)
        except Exception as e:
            assert "killed after the write" in str(e)
        return stream.schema

    run()
    put(source, "1", [{"path": "b", "text": "other " * 400}, {"path": "c", "text": ""}])
    run(break_at=1)
    kind = run()  # batch 1 is replayed, and is there already
    put(source, "2", [{"path": "d", "text": "last"}])
    run()
    got = once.committed(spark, path, kind)
    want = stateful.ingested(spark.createDataFrame([("a", "word " * 400), ("b", "other " * 400), ("d", "last")], schema))
    assert sorted((r.path, r.start, r.content) for r in got.collect()) == sorted((r.path, r.start, r.content) for r in want.collect())
    assert sorted((r.batch, r["rows"]) for r in once.commits(spark, path).collect()) == sorted((k, got.where(F.col("path").isin(p)).count()) for k, p in enumerate(["a", "b", "d"]))


def test_the_writer_of_a_stream_writes_once(spark, tmp_path):
    path, source, schema = str(tmp_path / "table"), tmp_path / "in", "path string, text string"
    put(source, "0", [{"path": "a", "text": "x"}])
    stream = spark.readStream.schema(schema).json(str(source))
    for _ in range(2):
        run = once.written_once(stream, path, "plain").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(60)
        assert run.exception() is None
    assert once.committed(spark, path, stream.schema).count() == 1


@pytest.mark.parametrize("late", ["0 seconds", "1 hour"])
def test_no_events_give_nothing(spark, tmp_path, late):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "0", [])
    assert whole(spark, tmp_path, [], LOGIN, lambda s: timed.locks(s, late=late)) == []


def test_a_user_is_one_item_of_state():
    """what comes or stays at one time is one item of the store, however many events it has."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    class Held(list):
        put = lambda self, items: self.__setitem__(slice(None), items)
        get = lambda self: iter(list(self))
        exists = lambda self: bool(self)
        appendValue, appendList = list.append, list.extend

    state, timers = Held(), []
    lock = timed.LoginLock(3, 900)
    lock.init(SimpleNamespace(getListState=lambda *_: state, registerTimer=timers.append))
    events = [Row(at=1_000_000 * n, event_id=n, ok=n == 50) for n in range(100)]
    assert not list(lock.handleInputRows((7,), iter(events[::-1]), None)) and len(state) == 1 and timers == [1]
    clock = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000 * s)
    out = list(lock.handleExpiredTimer((7,), clock(60), None))
    assert [(r.event_id, r.failures) for r in out] == [(n, n + 1) for n in range(2, 50)] + [(n, n - 50) for n in range(53, 61)] and len(state) == 1 and timers[1:] == [61_001]
    out = list(lock.handleExpiredTimer((7,), clock(2000), None))
    assert [(r.event_id, r.failures) for r in out] == [(n, n - 50) for n in range(61, 100)] and not state
