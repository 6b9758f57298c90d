"""Reminders about tasks that stand still, as a stream with timers and marks of what was sent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.reminders import Limits, due_times

OUTPUT = "task long, kind string, since timestamp, due timestamp"


class Standstill(StatefulProcessor):
    """The last change of a task, what was sent about it, and a timer for the next reminder."""

    def __init__(self, limits: Limits, horizon_ms: int):
        self.limits, self.horizon = limits, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, since long, due long, sent string, overdue long")

    def _open(self, state: tuple) -> list[tuple[str, int, int]]:
        """Reminders that weren't sent yet."""
        status, since, due, sent, overdue = state
        waiting = due_times(status, since, due, self.limits)
        return [x for x in waiting if x[0] not in sent.split(",") and not (x[0] == "overdue" and overdue == x[2])]

    def _fall_due(self, state: tuple, before: int, now: int, out: list) -> tuple:
        """Send what falls due before a time, unless its standstill began more than the horizon before now."""
        status, since, due, sent, overdue = state
        for kind, when, start in self._open(state):
            if when < before:
                if now - start <= self.horizon:
                    out.append((kind, start, when))
                sent = f"{sent},{kind}"
                overdue = start if kind == "overdue" else overdue
        return status, since, due, sent, overdue

    def _keep(self, state: tuple) -> None:
        """Store the state; one timer, for the next reminder, stands. A task that can't give any more is forgotten but for its overdue mark."""
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.last.update(state)
        if waiting := self._open(state):
            self.handle.registerTimer(waiting[0][1] + 1)

    def _frame(self, key: tuple, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"task": [key[0]] * len(out), "kind": [x[0] for x in out], "since": pd.to_datetime([x[1] for x in out], unit="ms"), "due": pd.to_datetime([x[2] for x in out], unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame.sort_values(["ms", "status"], na_position="first", kind="stable").drop_duplicates("ms", keep="last")
        state, out = self.last.get() if self.last.exists() else None, []
        now = int(timerValues.getCurrentWatermarkInMs())
        for ms, status, due in zip(frame["ms"], frame["status"], frame["due_ms"], strict=True):
            if state is not None:
                if ms < state[1]:  # an older change that comes late says nothing about what stands now
                    continue
                state = self._fall_due(state, int(ms), max(now, 0), out)
            state = (status, int(ms), None if pd.isna(due) else int(due), "", state[4] if state else None)
        self._keep(state)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        now = int(timerValues.getCurrentWatermarkInMs())
        state = self._fall_due(self.last.get(), now, now, out)  # all that is due: a timer set here would wait for the next batch
        self._keep(state)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def reminder_stream(changes: DataFrame, limits: Limits = Limits(), late: str = "10 minutes", horizon_hours: int = 24) -> DataFrame:  # noqa: B008
    """The rows of operators.reminders.reminders for a stream of changes (task long, at, status, due_at).

    A reminder is sent when the watermark has passed its time, once, however the changes are dealt to batches: what was
    sent is part of the task's state. Of standstills that began more than horizon_hours before the watermark nothing is
    sent, so that a stream that was down doesn't flood. A change older than the one that stands is left out. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = changes.withWatermark("at", late).selectExpr("task", "at", "unix_millis(at) AS ms", "status", "unix_millis(due_at) AS due_ms")
    return rows.groupBy("task").transformWithStateInPandas(statefulProcessor=Standstill(limits, horizon_hours * 3_600_000), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
