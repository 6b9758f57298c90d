"""Times of a task's stages, and thresholds over all scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordered import as_of, in_order


def minutes(start: Column, end: Column) -> Column:
    """Whole minutes from start to end; 0 where end is earlier or one is null."""
    return F.coalesce(F.greatest(F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60_000_000), F.lit(0)), F.lit(0))


def stage_times(deliverables: DataFrame, reviews: DataFrame) -> DataFrame:
    """task, versions, reworks, work_min, hub_min and van_min of each task.

    deliverables (task, id, kind, at), where kind is dispatch, supplement or anything else for a version; reviews
    (id, deliverable, relayed, at). Order is that of the ids. Work runs from the last dispatch before a version to it.
    The hub waits from the last version since the dispatch before to the next dispatch, and through its own reviews;
    relayed reviews are the other side's wait. A review starts where the one before it of that version ended, the first
    at the version. What comes before what is found by joins as of an id, for tasks of any length.
    """
    dispatched = deliverables.where("kind = 'dispatch'").select("task", "id", "at")
    versions = deliverables.where("kind NOT IN ('dispatch', 'supplement')").select("task", "id", "at")
    worked = as_of(versions, dispatched.withColumnRenamed("at", "start"), ["task"], "id", ["start"], strict=True)
    again = as_of(dispatched, versions.select("task", "id", F.col("id").alias("version"), F.col("at").alias("done")), ["task"], "id", ["version", "done"], strict=True)
    again = as_of(again, dispatched.select("task", "id", F.col("id").alias("before")), ["task"], "id", ["before"], strict=True)
    fresh = F.col("before").isNull() | (F.col("version") > F.col("before"))
    chain = as_of(reviews, reviews.select("deliverable", "id", F.col("at").alias("previous")), ["deliverable"], "id", ["previous"], strict=True)
    reviewed = chain.join(versions.select("task", F.col("id").alias("deliverable"), F.col("at").alias("delivered")), "deliverable")
    wait = minutes(F.coalesce("previous", "delivered"), F.col("at"))
    nought = F.lit(0).cast("long")
    parts = worked.select("task", F.lit(1).cast("long").alias("n"), minutes(F.col("start"), F.col("at")).alias("work"), nought.alias("hub"), nought.alias("van"))
    parts = parts.union(again.select("task", nought, nought, F.when(fresh, minutes(F.col("done"), F.col("at"))).otherwise(0), nought))
    parts = parts.union(reviewed.select("task", nought, nought, F.when(~F.col("relayed"), wait).otherwise(0), F.when(F.col("relayed"), wait).otherwise(0)))
    parts = parts.union(deliverables.where("kind = 'supplement'").select("task", nought, nought, nought, nought))
    sums = parts.groupBy("task").agg(F.sum("n").alias("versions"), F.sum("work").alias("work_min"), F.sum("hub").alias("hub_min"), F.sum("van").alias("van_min"))
    return sums.withColumn("reworks", F.greatest(F.col("versions") - 1, F.lit(0)))


def threshold_sweep(rows: DataFrame, score: str, positive: str, beta: float = 2.0) -> DataFrame:
    """threshold, tp, fp, recall, precision, f, dropped and best for each distinct score as a threshold: at it or above counts.

    rows without a score or a mark are left out. Scores are counted first, so that a sweep over any number of rows is
    prefix sums over the distinct scores. best marks the highest f, of equal ones at the lowest threshold.
    """
    one = F.col(positive).cast("long")
    counts = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(one).alias("p"), F.sum(1 - one).alias("q"))
    cum = in_order(counts, [], [F.col("threshold").desc()], {"p0": F.col("p"), "q0": F.col("q")})
    totals = counts.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    tp, fp = F.col("p0") + F.col("p"), F.col("q0") + F.col("q")
    swept = cum.crossJoin(F.broadcast(totals)).select("threshold", tp.alias("tp"), fp.alias("fp"), "all_p", "all_q")  # one row
    swept = swept.withColumn("recall", F.col("tp") / F.greatest("all_p", F.lit(1))).withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))
    b = beta * beta
    weighed = (1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall"))
    swept = swept.withColumn("f", F.round(F.when(F.col("tp") == 0, 0.0).otherwise(weighed), 9))
    top = swept.agg(F.min_by("threshold", F.struct(-F.col("f"), F.col("threshold"))).alias("top"))
    dropped = 1 - (F.col("tp") + F.col("fp")) / (F.col("all_p") + F.col("all_q"))
    rounded = [F.round(x, 9).alias(n) for x, n in ((F.col("recall"), "recall"), (F.col("precision"), "precision"), (F.col("f"), "f"), (dropped, "dropped"))]
    return swept.crossJoin(F.broadcast(top)).select("threshold", "tp", "fp", *rounded, (F.col("threshold") == F.col("top")).alias("best"))  # one row
