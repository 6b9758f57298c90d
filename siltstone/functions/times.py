"""Time functions on columns. What is now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours looked back by default, on Mondays, and at most; minutes between reminders; reminders before the
#: escalation and at most; hours of the day, at UTC+8, in which it may happen.
DAY_HOURS, MONDAY_HOURS, MOST_HOURS = 24, 72, 216
GAPS, LATER_GAP, ESCALATE_AFTER, REMIND_MOST, WAKING = (15, 15, 30), 60, 3, 24, (8, 23)


def _minus_hours(ts: Column, hours: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.lit(hours).cast("long") * 3_600_000_000)


def at_utc8(ts: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + 8 * 3_600_000_000)


def in_window(event: Column, ingested: Column, start: Column, end: Column) -> Column:
    """Half-open by the event's time, else by its arrival; without both it is out."""
    at = F.coalesce(event, ingested)
    return F.coalesce((at >= start) & (at < end), F.lit(False))


def default_start(now: Column) -> Column:
    return _minus_hours(now, F.when(F.dayofweek(at_utc8(now)) == 2, MONDAY_HOURS).otherwise(DAY_HOURS))


def round_window(now: Column, mark: Column) -> Column:
    """start, end and truncated from the last round's end; a mark in the future isn't trusted."""
    floor = _minus_hours(now, MOST_HOURS)
    start = F.when(mark.isNull() | (mark >= now), default_start(now)).when(mark < floor, floor).otherwise(mark)
    return F.struct(start.alias("start"), now.alias("end"), F.coalesce((mark < now) & (mark < floor), F.lit(False)).alias("truncated"))


def task_window(now: Column, engine: Column, mark: Column) -> Column:
    """The earlier of the engine's start and the mark; round_window if the engine's start isn't in the past."""
    floor = _minus_hours(now, MOST_HOURS)
    want = F.least(engine, F.when(mark < now, mark))
    own = F.struct(F.greatest(want, floor).alias("start"), now.alias("end"), (want < floor).alias("truncated"))
    return F.when(F.coalesce(engine < now, F.lit(False)), own).otherwise(round_window(now, mark))


def parse_since(text: Column, now: Column) -> Column:
    """7d, 12h: that long before now; null for anything else."""
    n = F.regexp_extract(text, "^([0-9]{1,6})[dh]$", 1).try_cast("long")
    return F.when(n.isNotNull(), _minus_hours(now, n * F.when(F.endswith(text, F.lit("d")), 24).otherwise(1)))


def review_gap(reminded: Column) -> Column:
    """Minutes to wait before the next reminder."""
    out = F.when(reminded < 1, GAPS[0])
    for k, gap in enumerate(GAPS[1:], 1):
        out = out.when(reminded < k + 1, gap)
    return out.otherwise(LATER_GAP)


def remind_due(now: Column, since: Column, last: Column, reminded: Column) -> Column:
    start = F.when((reminded > 0) & last.isNotNull(), last).otherwise(since)
    return (reminded < REMIND_MOST) & (F.unix_micros(now) - F.unix_micros(start) >= review_gap(reminded).cast("long") * 60_000_000)


def escalate_due(now: Column, reminded: Column, escalated: Column) -> Column:
    hour = F.hour(at_utc8(now))
    return ~escalated & (reminded >= ESCALATE_AFTER) & (hour >= WAKING[0]) & (hour < WAKING[1])


def schedule_fires(minute: Column, last: Column, now: Column) -> Column:
    """Whether a minute of the day lies after last and up to now, also over midnight."""
    return F.when(last <= now, (minute > last) & (minute <= now)).otherwise((minute > last) | (minute <= now))
