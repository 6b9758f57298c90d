"""Which tasks stand still, from the changes of their status: acknowledgement, escalation, idleness, overdue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses in which a task can be overdue.
LIVE = ("dispatched", "in_progress", "returned")


@dataclass(frozen=True)
class Limits:
    """Minutes until a task that was dispatched has to be taken up, and until one in progress is idle."""

    ack_minutes: int = 30
    idle_minutes: int = 120
    #: Times ack_minutes after which a task that wasn't taken up is escalated.
    escalate: int = 2


def due_times(status: str | None, since: int, due: int | None, limits: Limits) -> list[tuple[str, int, int]]:
    """kind, when it falls due and when its standstill began, in milliseconds, of a task that stays as it is."""
    minute = 60_000
    out = []
    if status == "dispatched":
        out = [("ack", since + limits.ack_minutes * minute, since), ("escalate", since + limits.ack_minutes * limits.escalate * minute, since)]
    elif status == "in_progress":
        out = [("idle", since + limits.idle_minutes * minute, since)]
    if due is not None and status in LIVE:
        out.append(("overdue", max(due, since), due))
    return sorted(out, key=lambda x: (x[1], x[0]))


def reminders(changes: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """task, kind, since and due of every reminder that falls due up to now.

    changes (task, at, status, due_at): each a change or an activity, from which the task stays as it is until its next
    one; of changes of one task at one time the last status in order counts. A standstill gives ack after the minutes
    for taking up a dispatched task and escalate after a multiple of them, idle after those without activity; a live
    task whose due_at has come gives overdue, once for each due_at. What ends at the moment at which it would fall due
    gives none. So each reminder is there once, and the stream of the same changes gives the same.
    """
    once = changes.groupBy("task", "at").agg(F.max(F.struct("status", "due_at")).alias("x")).select("task", "at", "x.*")
    until = F.lead("at").over(Window.partitionBy("task").orderBy("at"))
    rows = once.withColumn("until", until)
    after = lambda n: F.timestamp_micros(F.unix_micros("at") + n * 60_000_000)
    late = F.greatest("due_at", "at")
    entry = lambda kind, since, due: F.struct(F.lit(kind).alias("kind"), since.alias("since"), due.alias("due"))
    given, at = F.col("status") == "dispatched", F.col("at")
    found = F.array(
        F.when(given, entry("ack", at, after(limits.ack_minutes))),
        F.when(given, entry("escalate", at, after(limits.ack_minutes * limits.escalate))),
        F.when(F.col("status") == "in_progress", entry("idle", at, after(limits.idle_minutes))),
        F.when(F.col("status").isin(*LIVE) & F.col("due_at").isNotNull(), entry("overdue", F.col("due_at"), late)),
    )
    each = rows.select("task", "until", F.explode(F.array_compact(found)).alias("r")).select("task", "until", "r.*")
    each = each.where((F.col("due") <= now) & (F.col("until").isNull() | (F.col("until") > F.col("due"))))
    return each.groupBy("task", "kind", "since").agg(F.min("due").alias("due"))
