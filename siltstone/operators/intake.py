"""Checks of a run's intake: what was swept, judged, dropped and documented, as counts for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.joins import join_checked
from siltstone.session import materialize

#: Percent of optional sources below which coverage is a warning, and of items from one platform from which spread is.
COVERED, CONCENTRATED = 60, 90
CHANNEL = "channel"
CHECKS = ("coverage", "judged_all", "pending_consistent", "yield", "window", "drop_explained", "dedup_noted", "evidence", "fallback", "spread")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def of_judging_roles(sweeps: DataFrame, judgements: DataFrame) -> DataFrame:
    """Sweeps of the roles that a run's judgements name, and those without a role; all of a run whose judgements name none."""
    roles = judgements.where(F.col("role") != "").select("run", "role").distinct()
    named = roles.select("run").distinct().withColumn("_some", F.lit(True))
    mine = sweeps.join(named, "run", "left").join(roles.withColumn("_own", F.lit(True)), ["run", "role"], "left")
    return mine.where(F.col("_some").isNull() | F.col("_own").isNotNull() | (F.coalesce("role", F.lit("")) == "")).drop("_some", "_own")


def coverage(sources: DataFrame, sweeps: DataFrame) -> DataFrame:
    """run, platform, source_key, listed, required and sweeps, found, ok, failed of the sources that a run swept.

    A sweep of a source that isn't listed counts for its platform's channel, if that is listed, else for itself. sources
    (platform, source_key, required) is a ledger that tells its rows apart; it is counted before it is sent to all tasks.
    """
    ledger = materialize(sources.select("platform", "source_key", "required"), "ledger")
    width = ledger.agg(F.max(F.octet_length("platform") + F.octet_length("source_key"))).first()[0] or 0
    exact = join_checked(sweeps, ledger.withColumn("_exact", F.lit(True)), ["platform", "source_key"], "left", width + 64)
    channels = materialize(ledger.where(F.col("source_key") == CHANNEL).select("platform", F.col("required").alias("_all")), "channels")
    both = join_checked(exact, channels.withColumn("_channel", F.lit(True)), ["platform"], "left", width + 64)
    listed = F.col("_exact").isNotNull() | F.col("_channel").isNotNull()
    key = F.when(F.col("_exact").isNull() & F.col("_channel").isNotNull(), CHANNEL).otherwise(F.col("source_key"))
    rows = both.select("run", "platform", key.alias("source_key"), listed.alias("listed"), F.coalesce("required", "_all", F.lit(False)).alias("required"), "found", "result")
    sums = [F.count("*").alias("sweeps"), F.sum("found").alias("found"), F.count_if(F.col("result") == "ok").alias("ok"), F.count_if(F.col("result") == "failed").alias("failed")]
    return rows.groupBy("run", "platform", "source_key", "listed", "required").agg(*sums)


def intake_checks(runs: DataFrame, sources: DataFrame, sweeps: DataFrame, items: DataFrame, traces: DataFrame, judgements: DataFrame) -> DataFrame:
    """run, check, state and n for each run and check: state is ok, warn, failed or skipped, n counts what is at fault.

    runs (run, start, end), start and end null where a window is open; sources (platform, source_key, required); sweeps
    (run, sweep_key, platform, source_key, role, tool, result, found, in_window, reviewed, unreviewed, corroborated);
    items (run, item_key, status, published_at, fetched_at, dedup_note, evidence_url, via), times as text; traces (run,
    item_key, reason); judgements (run, candidate_key, role, tier, image_seen). A run has the two checks of judgements
    if it has any, else that of the yield. Null counts as empty. All checks are sums for each run, which tasks add up
    before they are shuffled; what is checked row by row meets only its own run's window.
    """
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    own = materialize(of_judging_roles(sweeps, judgements), "own-sweeps")
    swept = sweeps.groupBy("run").agg(F.count("*").alias("n_sweeps"), *[count(F.col(c)).alias(f"s_{c}") for c in ("reviewed", "unreviewed", "corroborated")])
    api = F.col("tool") == "csw_api"
    owned = own.groupBy("run").agg(F.count("*").alias("n_own"), F.count_if(api).alias("n_api"), count(F.when(api, F.col("in_window"))).alias("unique"), count(F.when(api, F.col("unreviewed"))).alias("open"))
    failed = F.coalesce(F.col("result") == "failed", F.lit(False))
    dead = own.groupBy("run", "platform").agg(F.count_if(~failed).alias("good")).where("good = 0").groupBy("run").agg(F.count("*").alias("n_dead"))
    judged = judgements.groupBy("run").agg(F.count("*").alias("n_judged"), F.count_if(~F.coalesce("image_seen", F.lit(False))).alias("unseen"), F.count_if(~F.coalesce("image_seen", F.lit(False)) & (F.coalesce("tier", F.lit("")) != "pending_check")).alias("unseen_bad"))
    totals = sources.agg(F.count("*").alias("n_sources"), F.count_if("required").alias("n_required"))
    seen = coverage(sources, sweeps).where("listed").groupBy("run").agg(F.count_if("required").alias("required_seen"), F.count_if(~F.col("required")).alias("optional_seen"))

    explained = traces.where(F.coalesce("reason", F.lit("")) != "").select("run", "item_key").distinct().withColumn("_explained", F.lit(True))
    rows = items.join(runs, "run").join(explained, ["run", "item_key"], "left")
    published, fetched = F.col("published_at").try_cast("timestamp"), F.col("fetched_at").try_cast("timestamp")
    outside = F.coalesce(published < F.col("start"), F.lit(False)) | F.coalesce(published > F.col("end"), F.lit(False)) | F.coalesce(fetched < published, F.lit(False))
    dropped = F.coalesce(F.col("status") == "dropped", F.lit(False))
    listed = rows.groupBy("run").agg(
        F.count("*").alias("n_items"),
        F.count_if(_blank(F.col("published_at"))).alias("undated"),
        F.count_if(~_blank(F.col("published_at")) & published.isNull()).alias("unparsed"),
        F.count_if(outside).alias("outside"),
        F.count_if(dropped & F.col("_explained").isNull()).alias("unexplained"),
        F.count_if(~dropped & _blank(F.col("dedup_note"))).alias("unnoted"),
        F.count_if(~dropped & ~F.coalesce(F.trim("evidence_url").rlike(r"^(?i)https://[^/?#\s]+"), F.lit(False))).alias("no_evidence"),
    )
    traced = traces.groupBy("run").agg(F.count("*").alias("n_traces"))
    platforms = own.groupBy("run", F.col("sweep_key").alias("via")).agg(F.max("platform").alias("platform"))
    spread = items.join(platforms, ["run", "via"]).groupBy("run", "platform").agg(F.count("*").alias("k")).groupBy("run").agg(F.sum("k").alias("known"), F.max("k").alias("most"))

    out = runs.select("run").distinct().crossJoin(F.broadcast(totals))  # one row
    for part in (swept, owned, dead, judged, seen, listed, traced, spread):
        out = out.join(part, "run", "left")
    out = out.fillna(0)
    c = F.col
    missed = c("n_required") - c("required_seen")
    optional = c("n_sources") - c("n_required")
    thin = (optional > 0) & (F.floor(c("optional_seen") * 100 / F.greatest(optional, F.lit(1))) < COVERED)
    gap = F.greatest(c("s_reviewed") - c("s_corroborated"), F.lit(0)) - c("n_items")
    short = F.greatest(c("unique") - c("n_judged"), F.lit(0))
    one_sided = (F.floor(c("most") * 100 / F.greatest(c("known"), F.lit(1))) >= CONCENTRATED) & (c("n_sources") > 1)
    judging = c("n_judged") > 0

    def state(skip: Column, fail: Column, warn: Column) -> Column:
        return F.when(skip, "skipped").when(fail, "failed").when(warn, "warn").otherwise("ok")

    no, no_items = F.lit(False), c("n_items") == 0
    found = {
        "coverage": (state((c("n_sweeps") == 0) | (c("n_sources") == 0), missed > 0, thin), missed, None),
        "judged_all": (state(c("n_api") == 0, (c("open") > 0) | (short > 0), no), F.when(c("open") > 0, c("open")).otherwise(short), judging),
        "pending_consistent": (state(no, c("unseen_bad") > 0, c("unseen") > 0), c("unseen_bad"), judging),
        "yield": (state((c("n_sweeps") == 0) | ((c("s_reviewed") == 0) & (c("s_unreviewed") == 0)) | ((gap > 0) & (c("n_traces") == 0)), gap > 0, c("s_unreviewed") > 0), F.greatest(gap, F.lit(0)), ~judging),
        "window": (state(no_items, c("outside") > 0, c("undated") + c("unparsed") > 0), c("outside"), None),
        "drop_explained": (state(c("n_traces") == 0, c("unexplained") > 0, no), c("unexplained"), None),
        "dedup_noted": (state(no_items, no, c("unnoted") > 0), c("unnoted"), None),
        "evidence": (state(no_items, no, c("no_evidence") > 0), c("no_evidence"), None),
        "fallback": (state(c("n_own") == 0, c("n_dead") > 0, no), c("n_dead"), None),
        "spread": (state(c("known") == 0, no, one_sided), F.when(one_sided, c("most")).otherwise(0), None),
    }
    entries = []
    for name in CHECKS:
        of, n, only = found[name]
        entry = F.struct(F.lit(name).alias("check"), of.alias("state"), n.cast("long").alias("n"))
        entries.append(entry if only is None else F.when(only, entry))
    return out.select("run", F.explode(F.array_compact(F.array(*entries))).alias("x")).select("run", "x.*")
