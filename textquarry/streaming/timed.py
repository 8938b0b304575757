"""Keyed stream state with clocks: completion with a time to live, task sweeps, login locks in event order, judging by count or time.

Late and repeated rows are part of every definition. Processors with an event clock act when the watermark passes, so their
results don't depend on the order in which rows arrive; what is later than the watermark is dropped by Spark. Processors with a
wall clock hold state for a time to live. State is typed and keyed, a row a batch, event or item, and always ends.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FINAL = ("SUCCESS", "FAILURE", "DEAD")


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return [row for frame in frames for row in zip(*(frame[c].tolist() for c in columns))]


def _frame(rows: list[tuple], names: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names.split(), dtype=object)


class Completion(StatefulProcessor):
    """STR5: an asset is emitted once, when as many distinct batches are corrected as it has; a batch redelivered replaces itself."""

    def __init__(self, ttl_s: int):
        self.ttl_ms = 1000 * ttl_s

    def init(self, handle) -> None:
        self.batches = handle.getMapState("batches", "batch_index int", "status string", self.ttl_ms)
        self.asset = handle.getValueState("asset", "total int, emitted boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, emitted = self.asset.get() if self.asset.exists() else (0, False)
        held, new = {b: s for (b,), (s,) in self.batches.iterator()}, {}
        for batch, status, count in _rows(rows, "batch_index", "status", "total_batches"):
            new[int(batch)] = status
            total = max(total, int(count))
        for batch, status in new.items():
            if held.get(batch) != status:
                self.batches.updateValue((batch,), (status,))
        complete = not emitted and total > 0 and sum(s == "corrected" for s in (held | new).values()) >= total
        self.asset.update((total, emitted or complete))
        yield _frame([(key[0], total)] if complete else [], "asset_id batches")

    def close(self) -> None:
        pass


def completed_assets(batches: DataFrame, ttl_s: int = 7 * 86400) -> DataFrame:
    """STR5 over batches(asset_id, batch_index, status, total_batches); an asset silent for the time to live is forgotten."""
    kind = dict(batches.dtypes)["asset_id"]
    return batches.groupBy("asset_id").transformWithStateInPandas(Completion(ttl_s), f"asset_id {kind}, batches int", "Append", "ProcessingTime")


class TaskClock(StatefulProcessor):
    """STR6, STR7: a task's newest state by event time, and what silence makes of it.

    A task that is STARTED for twice the limit, or QUEUED for the retention, turns DEAD by a timer; one that is finished
    for the retention is REMOVED with its state. An event that is older than the newest changes nothing but the first start.
    """

    NAMES = "task_id version status changed_at started_at completed_at"

    def __init__(self, limit_s: int, retention_s: int, wall_clock: bool):
        self.limit_ms, self.retention_ms, self.wall_clock = 2000 * limit_s, 1000 * retention_s, wall_clock

    def init(self, handle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "version bigint, at bigint, event_id bigint, status string, started bigint, completed bigint")

    def due(self, at: int, status: str) -> int:
        return at // 1000 + (self.limit_ms if status == "STARTED" else self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.task.get() if self.task.exists() else None
        version, newest, last, status, started, completed = held or (0, None, None, None, None, None)
        if held:
            self.handle.deleteTimer(self.due(newest, status))
        for at, event, kind in sorted(_rows(rows, "at", "event_id", "status")):
            if newest is None or (at, event) >= (newest, last):
                newest, last, status = at, event, kind
            if kind == "STARTED":
                started = at if started is None else min(started, at)
            if kind in FINAL:
                completed = at if completed is None else max(completed, at)
        self.task.update((version + 1, newest, last, status, started, completed))
        self.handle.registerTimer(self.due(newest, status))
        yield _frame([(key[0], version + 1, status, newest, started, completed)], self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, now = [], timerValues.getCurrentProcessingTimeInMs() if self.wall_clock else timerValues.getCurrentWatermarkInMs()
        held = self.task.get() if self.task.exists() else None
        while held and (due := self.due(held[1], held[3])) <= now:  # a newer event may have put it off; both ends may be past
            version, at, event, status, started, completed = held
            if status in FINAL:
                self.task.clear()
                out.append((key[0], version + 1, "REMOVED", at, started, completed))
                held = None
            else:
                held = (version + 1, 1000 * due, event, "DEAD", started, 1000 * due)
                out.append((key[0], version + 1, "DEAD", 1000 * due, started, 1000 * due))
        if held:
            self.task.update(held)
            self.handle.registerTimer(self.due(held[1], held[3]))
        yield _frame(out, self.NAMES)

    def close(self) -> None:
        pass


def task_clock(events: DataFrame, limit_s: int, retention_s: int, late: str = "0 seconds", wall_clock: bool = False) -> DataFrame:
    """STR6, STR7 over events(task_id, event_id, ts, status): every change of a task, numbered; times in microseconds.

    The clock is the watermark, or the wall clock, by which also a stream that has fallen silent as a whole is swept.
    """
    kind = dict(events.dtypes)["task_id"]
    rows = events if wall_clock else events.withWatermark("ts", late)
    schema = f"task_id {kind}, version bigint, status string, changed_at bigint, started_at bigint, completed_at bigint"
    rows = rows.withColumn("at", F.unix_micros("ts")).groupBy("task_id")
    return rows.transformWithStateInPandas(TaskClock(limit_s, retention_s, wall_clock), schema, "Append", "ProcessingTime" if wall_clock else "EventTime")


def newest_states(changes: DataFrame) -> DataFrame:
    """The table that the changes of task_clock amount to: each task's last state, without those removed."""
    last = lambda c: F.max_by(c, "version").alias(c)
    return changes.groupBy("task_id").agg(*map(last, ("status", "changed_at", "started_at", "completed_at"))).where("status <> 'REMOVED'")


class LoginLock(StatefulProcessor):
    """STR9: events wait until the watermark has passed them and then count in their own order; a success clears the failures before it.

    Users are many and each has few events, so rows come and go as rows: a frame for each user would cost more than its events.
    """

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window = limit, 1_000_000 * window_s

    def init(self, handle) -> None:
        self.handle = handle
        # Waiting events, and failures that still count, which have no event. An item of the list is all that came or stayed at
        # one time: the store takes each item singly, whatever it holds.
        self.held = handle.getListState("held", "at array<bigint>, event_id array<bigint>, ok array<boolean>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["event_id"], r["ok"]) for r in rows]
        self.held.appendValue(tuple(map(list, zip(*new))))
        self.handle.registerTimer(min(a for a, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = [row for item in self.held.get() for row in zip(*item)]
        # Failures within the window, the oldest first.
        times = deque(a for a, e, _ in held if e is None)
        waiting = sorted(h for h in held if h[1] is not None)
        out, count = [], 0
        for at, event, ok in waiting:
            if at > passed:
                break
            count += 1
            if ok:
                times.clear()
                continue
            while times and at - times[0] > self.window:
                times.popleft()
            times.append(at)
            if len(times) >= self.limit:
                out.append(Row(user_id=key[0], event_id=event, failures=len(times)))
        left = waiting[count:]
        while times and passed - times[0] > self.window:
            times.popleft()
        if left or times:  # again when the next event is due, or the last failure out of the window
            self.held.put([tuple(map(list, zip(*((t, None, False) for t in times), *left)))])
            self.handle.registerTimer(min(([left[0][0] // 1000 + 1] if left else []) + ([(times[-1] + self.window) // 1000 + 1] if times else [])))
        else:
            self.held.clear()
        return iter(out)

    def close(self) -> None:
        pass


def locks(events: DataFrame, limit: int = 5, window_s: int = 900, late: str = "1 minute") -> DataFrame:
    """STR9 over events(user_id, event_id, ts, ok): the failures that reach the limit, once the watermark has passed them."""
    kind = dict(events.dtypes)["user_id"]
    rows = events.withWatermark("ts", late).select("ts", "user_id", F.unix_micros("ts").alias("at"), F.col("event_id").cast("bigint").alias("event_id"), "ok")
    return rows.groupBy("user_id").transformWithState(LoginLock(limit, window_s), f"user_id {kind}, event_id bigint, failures bigint", "Append", "EventTime")


class JudgeBuffer(StatefulProcessor):
    """STR1, UDF3: items of a stage wait until size are there, or the oldest has waited long enough; then one call judges them."""

    NAMES = "stage id safe batch_size"

    def __init__(self, judge: Callable[[list[str]], list[bool]], size: int, wait_ms: int):
        self.judge, self.size, self.wait_ms = judge, size, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "id bigint, text string")
        self.due = handle.getValueState("due", "ms bigint")

    def judged(self, stage: str, items: list[tuple]) -> list[tuple]:
        try:
            verdicts = list(self.judge([text for _, text in items]))
        except Exception:  # undecided, by the guard's mode
            verdicts = []
        if len(verdicts) != len(items):
            verdicts = [None] * len(items)
        return [(stage, i, v, len(items)) for (i, _), v in zip(items, verdicts)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = [*(self.items.get() if self.items.exists() else ()), *((int(i), t or "") for i, t in _rows(rows, "id", "text"))]
        out, whole = [], len(items) // self.size * self.size
        for at in range(0, whole, self.size):
            out += self.judged(key[0], items[at : at + self.size])
        if whole and self.due.exists():  # the oldest has gone
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if left := items[whole:]:
            self.items.put(left)
            if not self.due.exists():
                due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                self.handle.registerTimer(due)
                self.due.update((due,))
        else:
            self.items.clear()
        yield _frame(out, self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items = list(self.items.get()) if self.items.exists() else []
        self.items.clear()
        self.due.clear()
        yield _frame(self.judged(key[0], items) if items else [], self.NAMES)

    def close(self) -> None:
        pass


def judged_items(items: DataFrame, judge: Callable[[list[str]], list[bool]], size: int = 8, wait_ms: int = 250, lanes: int = 1) -> DataFrame:
    """STR1 over items(stage, id, text): stage, id, safe (null: undecided) and the size of the call's batch.

    A stage's items go through as many buffers as there are lanes, by id, so that one stage can use many tasks.
    """
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")
    rows = items.select("stage", F.col("id").cast("bigint").alias("id"), "text", lane.alias("lane"))
    return rows.groupBy("stage", "lane").transformWithStateInPandas(JudgeBuffer(judge, size, wait_ms), "stage string, id bigint, safe boolean, batch_size int", "Append", "ProcessingTime")
