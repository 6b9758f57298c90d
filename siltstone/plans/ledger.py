"""Queries of record keeping and workflows: upserts, claims, replay, progress, checks, inboxes, digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import flow, ordered, records
from siltstone.plans.registry import query

c = F.col

#: Columns that order the lines of an order without ties that matter.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LINE = ", ".join(LINE)


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("o015_replay", """WITH r AS (SELECT o_orderkey, sha256('{"account":' || o_custkey || ',"status":"' || o_orderstatus || '"}') AS request FROM orders) SELECT o_orderkey, request, count(*) OVER (PARTITION BY request) AS answer FROM r""")
def _(t):
    asked = t.orders.select("o_orderkey", records.request_hash(account=c("o_custkey"), status=c("o_orderstatus")).alias("request"))
    recorded = asked.groupBy("request").agg(F.count("*").alias("answer"))
    return records.replay(asked, recorded, "request", "answer")


@query("o018_enqueue_once", "SELECT c_custkey, coalesce(k, -c_custkey) AS entry, k IS NOT NULL AS existed FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    have = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"))
    return t.customer.join(have, "c_custkey", "left").select("c_custkey", F.coalesce("k", -c("c_custkey")).alias("entry"), c("k").isNotNull().alias("existed"))


@query("o021_keep_human_flag", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN d.n_chars ELSE l.quality END AS value, coalesce(l.toxic = 0, true) AS active FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def _(t):
    old = t.labels.select("doc_id", c("quality").cast("long").alias("value"), (c("toxic") == 0).alias("active"))
    new = t.documents.select("doc_id", c("n_chars").alias("value"), F.lit(True).alias("active"))
    return records.upsert(old, new, ["doc_id"], {"value": "overwrite", "active": "first"})


@query("o023_vector_merge", "SELECT coalesce(e.vec_id, d.doc_id) AS vec_id, CASE WHEN d.doc_id IS NOT NULL THEN d.lang ELSE e.label::VARCHAR END AS tag FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id")
def _(t):
    old = t.embeddings.select("vec_id", c("label").cast("string").alias("tag"))
    return records.upsert(old, t.documents.select(c("doc_id").alias("vec_id"), c("lang").alias("tag")), ["vec_id"], {"tag": "overwrite"})


@query("o025_inherit_by_hash", "SELECT doc_id, coalesce(quality, max(quality) OVER (PARTITION BY text)) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return records.inherit(rows, "h", "quality").select("doc_id", "quality")


@query("o026_claim_due", "SELECT o_orderkey, epoch_us(TIMESTAMP '1998-01-01 00:01:00') AS leased_until FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    due = t.orders.where((c("o_orderstatus") == "P") & (c("o_orderdate") <= _day("1998-01-01"))).orderBy("o_orderdate", "o_orderkey").limit(100)
    return due.select("o_orderkey", F.unix_micros((_day("1998-01-01") + F.make_dt_interval(mins=F.lit(1))).cast("timestamp")).alias("leased_until"))


@query("o068_tag_overlap", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w IN ('small', 'ring', 'red'))) AS hits FROM part WHERE hits > 0 ORDER BY hits DESC, p_size DESC, p_partkey DESC LIMIT 50")
def _(t):
    hits = F.size(F.filter(F.split("p_name", " "), lambda w: w.isin("small", "ring", "red"))).cast("long")
    return t.part.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc("p_size"), F.desc("p_partkey")).limit(50).select("p_partkey", "hits")


@query("o071_latest_sync", "SELECT c_nationkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS run FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    rows = t.orders.where("o_orderstatus = 'F'").join(t.customer, c("o_custkey") == c("c_custkey"))
    return rows.groupBy("c_nationkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query("o075_composite_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY round(0.6 * c_acctbal / 10000 + 0.4 * coalesce(n, 0) / 10, 6) DESC, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    n = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    score = F.round(0.6 * c("c_acctbal") / 10000 + 0.4 * F.coalesce("n", F.lit(0)) / 10, 6)
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(score.desc(), "c_custkey")
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", F.row_number().over(w).alias("place"))


@query("o077_throughput", "SELECT user_id, greatest(2 * count(*) FILTER (WHERE event_type = 'click'), 3 * count(*) FILTER (WHERE event_type = 'view')) + 10 * count(*) FILTER (WHERE event_type = 'purchase') AS seconds FROM events GROUP BY 1")
def _(t):
    n = {k: F.count_if(c("event_type") == k) for k in ("click", "view", "purchase")}
    return t.events.groupBy("user_id").agg((F.greatest(2 * n["click"], 3 * n["view"]) + 10 * n["purchase"]).alias("seconds"))


@query("o088_judging_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality * 2 + toxic DESC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", "lang", (c("quality") * 2 + c("toxic")).alias("worth"))
    return ordered.in_order(rows, ["lang"], [c("worth").desc_nulls_last(), c("doc_id").asc()]).select("doc_id", (c("rank") + 1).alias("place"))


@query("o090_pin_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderpriority", "o_orderkey")
    return t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("o091_pick_figures", f"""SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY e, {_LINE}) AS rank FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS e FROM lineitem WHERE l_returnflag <> 'R'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY e, {_LINE}) = 1) QUALIFY rank <= 3""")
def _(t):
    """Own figures before external ones, each picture once, at most three."""
    rows = t.lineitem.where("l_returnflag <> 'R'").withColumn("e", F.when(c("l_linestatus") == "F", 0).otherwise(1))
    once = records.keep_first(rows, ["l_orderkey", "l_partkey"], ["e", *LINE])
    return records.top_per_key(once, ["l_orderkey"], ["e", *LINE], 3).select("l_orderkey", "l_partkey", "rank")


@query("o094_pool_size", "SELECT l_orderkey, least(greatest(count(*) * 3, 10), 100) AS pool FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.least(F.greatest(F.count("*") * 3, F.lit(10)), F.lit(100)).alias("pool"))


@query("o095_next_ready", "SELECT o_custkey, min(o_orderkey) AS next FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') GROUP BY 1")
def _(t):
    done = t.lineitem.where("l_returnflag = 'A'").select(c("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.min("o_orderkey").alias("next"))


@query("o096_concat_sweeps", "SELECT id, min(sweep) AS sweep FROM (SELECT doc_id AS id, 1 AS sweep FROM labels UNION ALL SELECT vec_id, 2 FROM embeddings UNION ALL SELECT doc_id, 3 FROM documents) GROUP BY 1")
def _(t):
    """Which sweep comes first is a minimum, so that keys are combined before they are shuffled."""
    sweeps = [(t.labels, "doc_id"), (t.embeddings, "vec_id"), (t.documents, "doc_id")]
    parts = [df.select(c(k).alias("id"), F.lit(n).alias("sweep")) for n, (df, k) in enumerate(sweeps, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.min("sweep").alias("sweep"))


@query("o114_weight_batches", f"""WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS i, (1 + floor(l_quantity / 10))::BIGINT AS w FROM lineitem),
r(l_orderkey, i, batch, held) AS (SELECT l_orderkey, i, 0::BIGINT, w FROM l WHERE i = 1 UNION ALL SELECT l.l_orderkey, l.i, CASE WHEN held + w > 8 THEN batch + 1 ELSE batch END, CASE WHEN held + w > 8 THEN w ELSE held + w END FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.i = r.i + 1)
SELECT l_orderkey, i, batch FROM r""")
def _(t):
    """Inputs of one request, here an order, go into batches of weight 8 in turn."""
    w = (1 + F.floor(c("l_quantity") / 10)).cast("long")
    inputs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE, w.alias("w")))).alias("x"))
    batches = records.weight_batches(F.transform("x", lambda v: v["w"]), 8)
    rows = inputs.select("l_orderkey", F.posexplode(batches).alias("i", "batch"))
    return rows.select("l_orderkey", (c("i") + 1).alias("i"), "batch")


@query("o117_exclusions", "SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) <= 5) ON s_nationkey = c_nationkey WHERE 1 - abs(c_acctbal - s_acctbal) / 20000 >= 0.85 AND abs(c_acctbal - s_acctbal) / 10000 < 0.3")
def _(t):
    rules = records.top_per_key(t.supplier, ["s_nationkey"], [F.desc("s_suppkey")], 5)
    apart = F.abs(c("c_acctbal") - c("s_acctbal"))
    return t.customer.join(rules, c("s_nationkey") == c("c_nationkey")).where((1 - apart / 20000 >= 0.85) & (apart / 10000 < 0.3)).select("c_custkey", "s_suppkey")


@query("o123_topics", """SELECT c_custkey, min(struct_pack(a := CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, b := CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, k := o_orderkey)).k AS best, count(o_orderkey) AS members
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT c_custkey, -1, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(t):
    tier = F.when(c("o_orderstatus") == "F", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    order = F.struct(tier.alias("a"), F.when(c("o_orderpriority") == "1-URGENT", 0).otherwise(1).alias("b"), "o_orderkey")
    groups = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", order).alias("best"), F.count("*").alias("members"))
    return t.customer.select("c_custkey").join(groups, "c_custkey", "left").fillna({"best": -1, "members": 0})


@query("o147_state_digest", f"SELECT l_orderkey, substr(sha256(string_agg(l_linenumber || ':' || l_returnflag || ':' || l_linestatus, '|' ORDER BY {_LINE})), 1, 16) AS digest FROM lineitem GROUP BY 1")
def _(t):
    state = F.array_sort(F.collect_list(F.struct(*LINE, F.concat_ws(":", "l_linenumber", "l_returnflag", "l_linestatus").alias("s"))))
    return t.lineitem.groupBy("l_orderkey").agg(state.alias("x")).select("l_orderkey", F.substring(F.sha2(F.array_join(F.transform("x", lambda v: v["s"]), "|"), 256), 1, 16).alias("digest"))


@query("o153_definition_checks", """SELECT l_orderkey AS run, bool_or(l_linenumber = 1) AS has_entry, max(struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, q := l_quantity, e := l_extendedprice, f := l_returnflag)).f = 'N' AS ends_in_merge,
bool_and(s_suppkey IS NOT NULL) AS roles_exist, count(DISTINCT l_linenumber) = count(*) AS steps_once FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.supplier.select("s_suppkey", F.lit(True).alias("known")), c("s_suppkey") == c("l_suppkey"), "left")
    return rows.groupBy(c("l_orderkey").alias("run")).agg(
        F.bool_or(c("l_linenumber") == 1).alias("has_entry"),
        (F.max_by("l_returnflag", F.struct(*LINE)) == "N").alias("ends_in_merge"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("roles_exist"),
        (F.size(F.collect_set("l_linenumber")) == F.count("*")).alias("steps_once"),
    )


@query("o154_downstream", "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS up, p_partkey AS down FROM part WHERE p_partkey > 0), r(node, reach) AS (SELECT up, down FROM e UNION SELECT r.node, e.down FROM r JOIN e ON e.up = r.reach) SELECT node, reach FROM r")
def _(t):
    return flow.closure(t.part.where("p_partkey > 0").selectExpr("p_partkey DIV 2 AS up", "p_partkey AS down"))


@query("o155_progress", """SELECT o_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS written, greatest(4 - count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS gap,
CASE WHEN bool_or(l_returnflag = 'R') THEN 'review' WHEN o_orderstatus = 'P' THEN 'hub' WHEN count(l_orderkey) = 0 THEN 'not started' ELSE 'none' END AS blocker FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def _(t):
    """Lines are counted before they are joined."""
    lines = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count_if(c("l_linestatus") == "F").alias("written"), F.bool_or(c("l_returnflag") == "R").alias("back"), F.count("*").alias("n"))
    written = F.coalesce("written", F.lit(0))
    blocker = F.when(c("back"), "review").when(c("o_orderstatus") == "P", "hub").when(c("n").isNull(), "not started").otherwise("none")
    return t.orders.join(lines, "o_orderkey", "left").select("o_orderkey", written.alias("written"), F.greatest(4 - written, F.lit(0)).alias("gap"), blocker.alias("blocker"))


_CHECKS = {"empty": ("n_empty", "n_empty = 0"), "labelled": ("n_labelled", "n_labelled * 10 >= n"), "languages": ("n_lang", "n_lang > 1")}


@query("o156_quality_checks", """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars < 50) AS n_empty, count(quality) AS n_labelled, count(DISTINCT lang) AS n_lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, 'empty' AS check, CASE WHEN n < 3 THEN 'skipped' WHEN n_empty = 0 THEN 'ok' ELSE 'warn' END AS state FROM s UNION ALL SELECT source, 'labelled', CASE WHEN n < 3 THEN 'skipped' WHEN n_labelled * 10 >= n THEN 'ok' ELSE 'warn' END FROM s
UNION ALL SELECT source, 'languages', CASE WHEN n < 3 THEN 'skipped' WHEN n_lang > 1 THEN 'ok' ELSE 'warn' END FROM s""")
def _(t):
    """One row for each source and check; all checks come from one aggregate."""
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")
    s = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("n_chars") < 50).alias("n_empty"), F.count("quality").alias("n_labelled"), F.size(F.collect_set("lang")).alias("n_lang"))
    states = [F.struct(F.lit(k).alias("check"), F.when(c("n") < 3, "skipped").when(F.expr(ok), "ok").otherwise("warn").alias("state")) for k, (_, ok) in _CHECKS.items()]
    return s.select("source", F.inline(F.array(*states)))


@query("o157_judged_all", "SELECT source, count(quality) AS judged, count(*) - count(quality) AS unjudged, count(quality) >= count(*) AS complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    n, j = F.count("*"), F.count("quality")
    return rows.groupBy("source").agg(j.alias("judged"), (n - j).alias("unjudged"), (j >= n).alias("complete"))


@query("o160_review_waits", "SELECT o_orderkey, epoch_us(TIMESTAMP '1998-06-01') - epoch_us(w) AS waited_us FROM (SELECT o_orderkey, greatest(o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')) AS w FROM orders WHERE o_orderstatus = 'P') WHERE w <= TIMESTAMP '1998-06-01' AND w > TIMESTAMP '1998-06-01' - INTERVAL 480 HOUR")
def _(t):
    seen = t.lineitem.where("l_returnflag = 'A'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    rows = t.orders.where("o_orderstatus = 'P'").join(seen, "o_orderkey", "left").select("o_orderkey", F.greatest("o_orderdate", "s").alias("w"))
    age = F.unix_micros(_day("1998-06-01").cast("timestamp")) - F.unix_micros(c("w").cast("timestamp"))
    return rows.select("o_orderkey", age.alias("waited_us")).where((c("waited_us") >= 0) & (c("waited_us") < 480 * 3_600_000_000))


@query("o161_step_ledger", """WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n, max(struct_pack(p := l_partkey, s := l_suppkey, q := l_quantity, e := l_extendedprice, f := l_linestatus)).f AS f FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, n + 1 AS attempt, CASE WHEN f <> 'F' THEN 'rerun' WHEN bool_or(f <> 'F') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale' ELSE 'reused' END AS state FROM l""")
def _(t):
    """A step that is run again makes the successes after it stale."""
    steps = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max_by("l_linestatus", F.struct(*LINE[1:])).alias("f"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(c("f") != "F", "rerun").when(F.bool_or(c("f") != "F").over(w), "stale").otherwise("reused")
    return steps.select("l_orderkey", "l_linenumber", (c("n") + 1).alias("attempt"), state.alias("state"))


@query("o162_memo", "SELECT a.o_orderkey, b.k AS reused FROM orders a LEFT JOIN (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY ALL) b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority")
def _(t):
    fp = records.request_hash(customer=c("o_custkey"), priority=c("o_orderpriority")).alias("fp")
    valid = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 1000").groupBy(fp).agg(F.min("o_orderkey").alias("reused"))
    return t.orders.select("o_orderkey", fp).join(valid, "fp", "left").select("o_orderkey", "reused")


@query("o163_incremental", "SELECT o_orderkey FROM orders a JOIN (SELECT o_orderpriority, max(o_orderdate) AS cursor FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_orderpriority) WHERE o_orderdate >= cursor - INTERVAL 45 DAY")
def _(t):
    cursor = t.orders.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("cursor"))
    return t.orders.join(cursor, "o_orderpriority").where(c("o_orderdate") >= c("cursor") - F.make_dt_interval(F.lit(45))).select("o_orderkey")


@query("o165_active_feedback", "SELECT max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority HAVING max(o_orderdate) > TIMESTAMP '1997-06-01'")
def _(t):
    """The newest of a key supersedes the others; it counts until it expires."""
    last = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return last.where(c("x.o_orderdate") > _day("1997-06-01")).select("x.o_orderkey")


@query("o166_decisions", """SELECT o_orderkey, next, unnest(CASE next WHEN 'selected' THEN ['draft', 'review'] WHEN 'waiting' THEN ['remind'] ELSE [''] END) AS task FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'selected' WHEN o_orderstatus = 'P' THEN 'waiting' ELSE 'dropped' END AS next FROM orders)""")
def _(t):
    nxt = F.when(c("o_orderstatus") == "F", "closed").when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "selected").when(c("o_orderstatus") == "P", "waiting").otherwise("dropped")
    spawn = {"selected": ["draft", "review"], "waiting": ["remind"]}
    tasks = F.coalesce(*(F.when(c("next") == k, F.array(*map(F.lit, v))) for k, v in spawn.items()), F.array(F.lit("")))
    return t.orders.select("o_orderkey", nxt.alias("next")).select("o_orderkey", "next", F.explode(tasks).alias("task"))


@query("o167_transitions", "SELECT o_orderkey, o_orderstatus IN ('O', 'P') AS can_submit, o_orderstatus = 'O' AND o_totalprice > 0 AS can_cancel FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c("o_orderstatus").isin("O", "P").alias("can_submit"), ((c("o_orderstatus") == "O") & (c("o_totalprice") > 0)).alias("can_cancel"))


@query("o168_batches_of_eight", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8 AS batch FROM conversations")
def _(t):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.floor((n - 1) / 8).alias("batch"))


@query("o169_memory_lookup", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_size DESC, p_partkey DESC LIMIT 50")
def _(t):
    asked = "ring "
    rows = t.part if not asked.strip() else t.part.where(F.contains(F.lower("p_name"), F.lit(asked.strip().lower())))
    return rows.orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(50).select("p_partkey")


@query("o171_published_lookup", "SELECT c_custkey, count(o_orderkey) AS posts, CASE WHEN count(o_orderkey) > 0 THEN 'found' ELSE 'not_found_in_synced_records' END AS verdict, coalesce(max(epoch_us(o_orderdate)), -1) AS covered_us FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def _(t):
    posts = t.orders.where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("posts"), F.unix_micros(F.max("o_orderdate").cast("timestamp")).alias("covered_us"))
    rows = t.customer.select("c_custkey").join(posts, "c_custkey", "left").fillna({"posts": 0, "covered_us": -1})
    return rows.withColumn("verdict", F.when(c("posts") > 0, "found").otherwise("not_found_in_synced_records"))


@query("o172_prefill", """WITH p AS (SELECT l_orderkey, l_linenumber, max(struct_pack(p := l_partkey, s := l_suppkey)).p AS part FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT DISTINCT l.l_orderkey, l.l_linenumber, p.part, 'upstream' AS kind FROM lineitem l JOIN p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'supplement' FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0""")
def _(t):
    passed = t.lineitem.where("l_returnflag = 'A'").groupBy("l_orderkey", (c("l_linenumber") + 1).alias("l_linenumber")).agg(F.max_by("l_partkey", F.struct("l_partkey", "l_suppkey")).alias("part"))
    up = t.lineitem.select("l_orderkey", "l_linenumber").distinct().join(passed, ["l_orderkey", "l_linenumber"]).withColumn("kind", F.lit("upstream"))
    return up.unionByName(t.lineitem.where("l_returnflag = 'N' AND l_discount > 0").select("l_orderkey", "l_linenumber", c("l_partkey").alias("part"), F.lit("supplement").alias("kind")))


@query("o173_opinions", f"SELECT l_orderkey, string_agg(l_partkey, '; ' ORDER BY {_LINE}) AS opinions FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0 GROUP BY 1")
def _(t):
    said = F.array_sort(F.collect_list(F.struct(*LINE)))
    rows = t.lineitem.where("l_returnflag = 'A' AND l_discount > 0").groupBy("l_orderkey").agg(said.alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["l_partkey"].cast("string")), "; ").alias("opinions"))


@query("o174_inbox", """SELECT 'ready' AS box, o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' UNION ALL
SELECT 'review', o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE o_custkey END FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' UNION ALL
SELECT DISTINCT 'failed', o_orderkey, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def _(t):
    own = [c("o_orderkey").alias("id"), c("o_custkey").alias("owner")]
    ready = t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.lit("ready").alias("box"), *own)
    relayed = F.when(c("c_mktsegment") == "BUILDING", 0).otherwise(c("o_custkey"))
    review = t.orders.where("o_orderstatus = 'P'").join(t.customer, c("c_custkey") == c("o_custkey")).select(F.lit("review").alias("box"), own[0], relayed.alias("owner"))
    bad = t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(c("l_orderkey").alias("o_orderkey"))
    return ready.unionByName(review).unionByName(t.orders.join(bad, "o_orderkey", "left_semi").select(F.lit("failed").alias("box"), *own))


@query("o175_recent_digests", """SELECT o_orderkey, o_orderstatus, reason FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
LEFT JOIN (SELECT l_orderkey, max(struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, q := l_quantity, e := l_extendedprice, f := l_returnflag)).f AS reason FROM lineitem WHERE l_discount > 0 GROUP BY 1) ON l_orderkey = o_orderkey WHERE r <= 20""")
def _(t):
    recent = records.top_per_key(t.orders, ["o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 20)
    told = t.lineitem.where("l_discount > 0").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_returnflag", F.struct(*LINE)).alias("reason"))
    return recent.join(told, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "reason")


@query("o177_post_documents", """SELECT 'post-' || o_orderkey AS key, o_orderkey AS post FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT 'item-' || l_orderkey || '-' || l_linenumber, l_orderkey FROM lineitem WHERE l_returnflag = 'N' UNION ALL
SELECT 'body-' || o_orderkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')""")
def _(t):
    """The whole body of a reference, each keyed item, and the body of a post without items."""
    items = t.lineitem.where("l_returnflag = 'N'").select(c("l_orderkey").alias("post"), "l_linenumber").distinct()
    posts = t.orders.select(c("o_orderkey").alias("post"), "o_orderstatus")
    whole = posts.where("o_orderstatus = 'F'").select(F.concat(F.lit("post-"), "post").alias("key"), "post")
    bare = posts.where("o_orderstatus <> 'F'").join(items.select("post"), "post", "left_anti").select(F.concat(F.lit("body-"), "post").alias("key"), "post")
    return whole.unionByName(items.select(F.concat(F.lit("item-"), "post", F.lit("-"), "l_linenumber").alias("key"), "post")).unionByName(bare)


@query("o178_decision_text", "SELECT o_orderkey || '#' || o_custkey AS key, concat_ws(chr(10), 'status: ' || o_orderstatus, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'priority: ' || o_orderpriority END) AS body, o_orderstatus = 'P' AS excludes FROM orders")
def _(t):
    lines = [F.concat(F.lit("status: "), "o_orderstatus"), F.when(c("o_orderpriority") != "4-NOT SPECIFIED", F.concat(F.lit("priority: "), "o_orderpriority"))]
    return t.orders.select(F.concat_ws("#", "o_orderkey", "o_custkey").alias("key"), F.concat_ws("\n", *lines).alias("body"), (c("o_orderstatus") == "P").alias("excludes"))


@query("o180_manifest_document", "SELECT p_partkey, p_brand || ' · ' || p_name || chr(10) || p_type AS title, p_size > 0 AND p_type <> 'PROMO' AND p_retailprice > 1000 AS eligible FROM part")
def _(t):
    eligible = (c("p_size") > 0) & (c("p_type") != "PROMO") & (c("p_retailprice") > 1000)
    return t.part.select("p_partkey", F.concat_ws("\n", F.concat_ws(" · ", "p_brand", "p_name"), "p_type").alias("title"), eligible.alias("eligible"))


@query("o181_registration", """WITH b AS (SELECT o_custkey, min(struct_pack(p := o_orderpriority, k := o_orderkey)).k AS k, count(*) - 1 AS others FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
SELECT c_custkey, k AS primary_key, others, CASE WHEN o_orderstatus = 'F' THEN 'shortlisted' ELSE 'pending' END AS status, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY c_nationkey, o_orderstatus ORDER BY c_custkey) END AS place FROM b JOIN customer ON c_custkey = o_custkey JOIN orders ON o_orderkey = k""")
def _(t):
    live = t.orders.where("o_orderstatus IN ('F', 'O')").groupBy(c("o_custkey").alias("c_custkey"))
    best = live.agg(F.min(F.struct("o_orderpriority", "o_orderkey", "o_orderstatus")).alias("x"), (F.count("*") - 1).alias("others"))
    rows = best.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", "c_nationkey", "others", c("x.o_orderkey").alias("primary_key"), c("x.o_orderstatus").alias("s"))
    place = F.row_number().over(Window.partitionBy("c_nationkey", "s").orderBy("c_custkey"))
    short = c("s") == "F"
    return rows.select("c_custkey", "primary_key", "others", F.when(short, "shortlisted").otherwise("pending").alias("status"), F.when(short, place).alias("place"))


@query("o183_sweep_counts", "SELECT lang, source, count(*) AS seen, count(quality) AS judged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def _(t):
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("seen"), F.count("quality").alias("judged"))


@query("o188_history_note", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS approved, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'A') AS published FROM customer")
def _(t):
    out = t.lineitem.where("l_returnflag = 'A'").select(c("l_orderkey").alias("o_orderkey"))
    seen = t.orders.join(out, "o_orderkey", "left_semi").select(c("o_custkey").alias("c_custkey"), F.lit(True).alias("published")).distinct()
    last = t.orders.where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("approved"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").join(seen, "c_custkey", "left").fillna({"published": False})


@query("o192_active_exclusions", f"SELECT l_partkey, max(struct_pack(d := l_shipdate, k := l_orderkey, n := l_linenumber, s := l_suppkey, q := l_quantity, e := l_extendedprice, f := l_returnflag)).f <> 'R' AS active FROM lineitem GROUP BY 1")
def _(t):
    newest = F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))
    return t.lineitem.groupBy("l_partkey").agg((newest != "R").alias("active"))
