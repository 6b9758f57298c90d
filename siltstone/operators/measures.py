"""Measures of retrieval and judgement, and traces of what a fetch let through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pooled(routes: dict[str, DataFrame]) -> DataFrame:
    """query, key, routes and place of what several routes (query, key, rank) found: by the best rank, then by key.

    A query's pool has as many rows as its routes have in all, which each of them cuts.
    """
    rows = reduce(DataFrame.unionByName, (df.select("query", "key", "rank", F.lit(name).alias("route")) for name, df in routes.items()))
    pool = rows.groupBy("query", "key").agg(F.array_sort(F.collect_set("route")).alias("routes"), F.min("rank").alias("best"))
    return pool.select("query", "key", "routes", F.row_number().over(Window.partitionBy("query").orderBy("best", "key")).alias("place"))


def recall_by_route(pool: DataFrame, targets: DataFrame, ks: list[int], names: list[str]) -> DataFrame:
    """k, n, hits, rate and only_NAME for each k: queries with a target among their first k, and those where one route alone found it.

    targets (query, key) has all right answers; a query without any isn't counted. What counts for a query is its first target.
    """
    asked = targets.select("query").distinct()
    first = pool.join(targets.select("query", "key").distinct(), ["query", "key"]).groupBy("query").agg(F.min_by("routes", "place").alias("routes"), F.min("place").alias("place"))
    rows = asked.join(first, "query", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("place") <= F.col("k"), F.lit(False))
    alone = [F.count_if(hit & (F.array_join("routes", ",") == n)).alias(f"only_{n}") for n in names]
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 9).alias("rate"), *alone)


def traced(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows (sweep, pos, id, key, image_only, at) with outcome and dup_of.

    The first that holds: dup_in_sweep, another row of the id before it in its sweep; not_image_only; before, after and
    no_time by the half-open window; dup_across, a row of the id in the window in an earlier sweep, whose key is dup_of;
    in_window. Sweeps are in their order, rows in that of pos. First places are aggregates, so an id may have any rows.
    """
    first = rows.groupBy("sweep", "id").agg(F.min("pos").alias("_first"))
    seen = rows.join(first, ["sweep", "id"])
    kind = (
        F.when(F.col("pos") > F.col("_first"), "dup_in_sweep")
        .when(~F.coalesce("image_only", F.lit(False)), "not_image_only")
        .when(F.col("at").isNull(), "no_time").when(F.col("at") < start, "before").when(F.col("at") >= end, "after").otherwise("in_window")
    )
    seen = seen.withColumn("_kind", kind)
    place = F.struct("sweep", "pos")
    kept = seen.where("_kind = 'in_window'").groupBy("id").agg(F.min(place).alias("_place"), F.min_by("key", place).alias("_key"))
    out = seen.join(kept, "id", "left")
    again = (F.col("_kind") == "in_window") & (place > F.col("_place"))
    outcome = F.when(again, "dup_across").otherwise(F.col("_kind"))
    return out.select(*rows.columns, outcome.alias("outcome"), F.when(again, F.col("_key")).alias("dup_of"))


def stalled_sources(sweeps: DataFrame, returned: DataFrame, least_hours: int = 6) -> DataFrame:
    """sweep, last_before, first_after and reason of the sweeps that show that their source stood still.

    sweeps (sweep, start, end, found, in_window, result) that went well, have nothing in a window of least_hours or more,
    and of which no returned row (sweep, ingested_at) came in within it. reason is nothing_returned, interrupted (rows
    came in before and after), stopped (only before) or outside.
    """
    long = (F.unix_seconds("end") - F.unix_seconds("start")) >= least_hours * 3600
    quiet = sweeps.where(long & (F.col("result") == "ok") & (F.col("in_window") == 0))
    both = quiet.join(returned, "sweep", "left")
    t = F.col("ingested_at")
    sums = both.groupBy("sweep", "found").agg(F.count_if((t >= F.col("start")) & (t < F.col("end"))).alias("inside"), F.max(F.when(t < F.col("start"), t)).alias("last_before"), F.min(F.when(t >= F.col("end"), t)).alias("first_after"))
    reason = F.when(F.col("found") == 0, "nothing_returned").when(F.col("last_before").isNotNull() & F.col("first_after").isNotNull(), "interrupted").when(F.col("last_before").isNotNull(), "stopped").otherwise("outside")
    return sums.where("found = 0 OR inside = 0").select("sweep", "last_before", "first_after", reason.alias("reason"))


def verdict_tally(rows: DataFrame) -> DataFrame:
    """truth, n, right, wrong, undecided, both and same of judgements (truth, first, second), tiers of two passes.

    adopted is right with recommend or alternate, rejected and dropped with not_recommend; pending_check and no tier are
    undecided. both counts rows with a tier in either pass, same those where the two agree.
    """
    decided = F.col("first").isNotNull() & (F.col("first") != "pending_check") & F.col("truth").isin("adopted", "rejected", "dropped")
    right = F.when(F.col("truth") == "adopted", F.col("first").isin("recommend", "alternate")).otherwise(F.col("first") == "not_recommend")
    both = F.col("first").isNotNull() & F.col("second").isNotNull()
    counts = {"right": decided & right, "wrong": decided & ~right, "undecided": ~decided, "both": both, "same": both & (F.col("first") == F.col("second"))}
    return rows.groupBy("truth").agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in counts.items()])
