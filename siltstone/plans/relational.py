"""Queries of joins, aggregates, windows, orders, retrieval, clusters and flows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import flow, graph, ordered, records, search
from siltstone.plans.registry import query
from siltstone.session import materialize

c = F.col


@query("o016_policy_upsert", """SELECT coalesce(a.o_orderkey, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.status ELSE o_orderstatus END AS status, CASE WHEN coalesce(b.note, '') = '' THEN o_orderpriority ELSE b.note END AS note, coalesce(b.price, o_totalprice) AS price
FROM orders a FULL JOIN (SELECT l_orderkey AS k, 'N' AS status, CASE WHEN max(l_returnflag) = 'R' THEN '' ELSE 'new' END AS note, CASE WHEN min(l_discount) > 0 THEN max(l_extendedprice) END AS price FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.k""")
def _(t):
    old = t.orders.select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("status"), c("o_orderpriority").alias("note"), c("o_totalprice").alias("price"))
    new = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.lit("N").alias("status"), F.when(F.max("l_returnflag") == "R", "").otherwise("new").alias("note"), F.when(F.min("l_discount") > 0, F.max("l_extendedprice")).alias("price"))
    return records.upsert(old, new, ["k"], {"status": "overwrite", "note": "keep", "price": "fill"})


@query("o017_hash_diff", """SELECT coalesce(vec_id, doc_id) AS k, CASE WHEN vec_id IS NULL THEN 'inserted' WHEN doc_id IS NULL THEN 'missing' WHEN label = quality THEN 'same' ELSE 'changed' END AS change FROM embeddings FULL JOIN labels ON vec_id = doc_id""")
def _(t):
    old = t.embeddings.select(c("vec_id").alias("k"), c("label").alias("v"))
    return records.changes(old, t.labels.select(c("doc_id").alias("k"), c("quality").alias("v")), ["k"], ["v"])


@query("o019_insert_or_ignore", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return records.insert_new(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("o020_guarded_status", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN o_orderstatus ELSE 'registered' END AS status FROM orders")
def _(t):
    return t.orders.select("o_orderkey", records.guarded_status(c("o_orderstatus"), F.lit("registered"), ["F"]).alias("status"))


@query("o024_manifest_reconcile", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id)) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    """Documents of the sources that a manifest (here labels) covers but doesn't list."""
    docs, listed = t.documents.select("doc_id", "source"), t.labels.select("doc_id")
    covered = docs.join(listed, "doc_id", "left_semi").select("source").distinct()
    return docs.join(covered, "source", "left_semi").join(listed, "doc_id", "left_anti").select("doc_id")


@query("o045_inner_joins", "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return rows.join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query("o046_computed_key_join", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL")
def _(t):
    a, b = t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.select("l_orderkey", (c("l_linenumber") - 1).alias("l_linenumber"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("o047_unjudged", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("o048_due_for_snapshot", "SELECT o_orderkey FROM orders WHERE o_orderdate <= DATE '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(t):
    seen = t.lineitem.where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderdate <= DATE '1997-01-01'").select("o_orderkey").join(seen, "o_orderkey", "left_anti")


@query("o049_confirmed_dependency", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


_LATEST = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1)"


@query("o050_latest_override", f"SELECT o_orderkey, o_orderstatus, l_returnflag AS override FROM orders LEFT JOIN (SELECT l_orderkey, max(struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, q := l_quantity, e := l_extendedprice, f := l_returnflag)).f AS l_returnflag FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    last = F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")).alias("x")
    over = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(last).select("o_orderkey", c("x.l_returnflag").alias("override"))
    return t.orders.select("o_orderkey", "o_orderstatus").join(over, "o_orderkey", "left")


@query("o051_wide_star", "SELECT o_orderkey, c_name, n_name, r_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    lines = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = t.orders.select("o_orderkey", c("o_custkey").alias("c_custkey")).join(t.customer, "c_custkey", "left").join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").join(t.region, c("n_regionkey") == c("r_regionkey"), "left")
    return rows.join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("o052_coverage_fallback", """WITH l AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS seg FROM customer WHERE c_acctbal > 5000), r AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS found FROM customer WHERE c_acctbal < 0 GROUP BY ALL)
SELECT l.nation, l.seg, coalesce(x.found, y.found, -1) AS found, CASE WHEN x.nation IS NOT NULL THEN 'exact' WHEN y.nation IS NOT NULL THEN 'channel' ELSE 'none' END AS match FROM l LEFT JOIN r x ON l.nation = x.nation AND l.seg = x.seg LEFT JOIN r y ON l.nation = y.nation AND y.seg = 'MACHINERY'
UNION ALL SELECT r.nation, r.seg, r.found, 'unlisted' FROM r ANTI JOIN l USING (nation, seg) WHERE r.seg <> 'MACHINERY'""")
def _(t):
    rows = t.customer.select(c("c_nationkey").alias("nation"), c("c_mktsegment").alias("seg"), "c_acctbal")
    left = rows.where("c_acctbal > 5000").select("nation", "seg").distinct()
    right = rows.where("c_acctbal < 0").groupBy("nation", "seg").agg(F.count("*").alias("found"))
    return records.fallback_join(left, right, ["nation", "seg"], ["nation"], {"seg": "MACHINERY"}, ["found"]).fillna(-1, ["found"])


@query("o053_alias_in_text", f"""SELECT doc_id, brand, max(struct_pack(n := length(alias), a := alias)).a AS alias FROM documents JOIN (SELECT DISTINCT item_id::VARCHAR AS brand, array_to_string(string_split(text, ' ')[1:3], ' ') AS alias FROM benchmark)
ON contains(translate(lower(text), '{X.ZERO_WIDTH}', ''), translate(lower(alias), '{X.ZERO_WIDTH}', '')) GROUP BY ALL""")
def _(t):
    """The first three words of each item, as an alias of several words."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return search.contains_alias(t.documents, "doc_id", "text", t.benchmark.select(c("item_id").cast("string").alias("brand"), first.alias("alias")))


@query("o054_similar_pairs", """SELECT i, j, round(s, 4) AS similarity FROM (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE s >= 0.7""")
def _(t):
    return search.similar_pairs(t.embeddings, 0.7)


_COSINE = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
_EDGES = f"""e AS (SELECT i, j, round((round(s, 4) - 0.7) / 0.3, 4) AS probability FROM (SELECT a.vec_id AS i, b.vec_id AS j, {_COSINE.format("a.embedding", "b.embedding")} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE s >= 0.7)"""


def _confirmed(t):
    """Pairs above the coarse line whose probability, here read off the similarity, reaches one half.

    That of a similarity of 0.8499 is 0.4997, so no pair below it is asked for.
    """
    pairs = search.similar_pairs(t.embeddings, 0.8499)
    return pairs.select("i", "j", F.round((c("similarity") - 0.7) / 0.3, 4).alias("probability")).where("probability >= 0.5")


@query("o092_vector_top_k", f"SELECT v.vec_id, round({_COSINE.format('v.embedding', 'q.embedding')}, 6) AS similarity, row_number() OVER (ORDER BY round({_COSINE.format('v.embedding', 'q.embedding')}, 6) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id = 7 AND v.vec_id <> 7 AND v.label < 5 QUALIFY rank <= 10")
def _(t):
    queries = t.embeddings.where("vec_id = 7").select(c("vec_id").alias("query_id"), "embedding")
    return search.nearest(queries, t.embeddings.where("label < 5"), 10).select("vec_id", "similarity", "rank")


@query("o119_edge_confirmation", f"WITH {_EDGES} SELECT i, j, probability FROM e WHERE probability >= 0.5")
def _(t):
    return _confirmed(t)


@query("o122_merge_notes", f"""WITH RECURSIVE {_EDGES}, k AS (SELECT i, j, probability FROM e WHERE probability >= 0.5), b AS (SELECT i AS u, j AS v FROM k UNION SELECT j, i FROM k), r(node, reach) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.reach = b.u)
SELECT (SELECT min(reach) FROM r WHERE node = i) AS event, i, j, i || ' = ' || j || ' ' || printf('%.2f', probability) AS note FROM k""")
def _(t):
    """Each confirmed edge with the event it ends up in, by the final root: a row for each line of an event's note."""
    edges = materialize(_confirmed(t), "confirmed")
    roots = graph.connected_components(edges, "i", "j")
    note = F.concat_ws(" ", c("i").cast("string"), F.lit("="), c("j").cast("string"), X.two_places(c("probability")))
    return edges.join(roots.select(c("node").alias("i"), c("component").alias("event")), "i").select("event", "i", "j", note.alias("note"))


@query("o055_same_key_pairs", "SELECT DISTINCT a.l_orderkey AS i, b.l_orderkey AS j FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey")
def _(t):
    a = t.lineitem.select("l_partkey", "l_suppkey", c("l_orderkey").alias("i")).distinct()
    return a.join(a.withColumnRenamed("i", "j"), ["l_partkey", "l_suppkey"]).where("i < j").select("i", "j").distinct()


@query("o056_time_tolerant_anti", "SELECT event_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000)")
def _(t):
    e = t.events.withColumn("ts", c("ts").cast("timestamp"))
    return records.near_in_time(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "ts", 600).select("event_id")


@query("o057_neighbour_context", "SELECT conv_id, turn, md5(coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '')) AS before_md5, md5(coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '')) AS after_md5 FROM conversations")
def _(t):
    rows = records.neighbours(t.conversations, ["conv_id"], ["turn"], "text", 2)
    return rows.select("conv_id", "turn", *(F.md5(F.array_join(n, "|")).alias(f"{n}_md5") for n in ("before", "after")))


@query("o058_key_sets", "(SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings)) UNION ALL (SELECT doc_id, 'labels' FROM (SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings))")
def _(t):
    a, b = t.labels.select("doc_id"), t.embeddings.select(c("vec_id").alias("doc_id"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.exceptAll(a.intersect(b)).distinct().withColumn("side", F.lit("labels")))


@query("o059_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("o060_effective_counts", "SELECT coalesce(f, o_orderstatus) AS tier, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, max(struct_pack(n := l_linenumber, f := l_returnflag)).f AS f FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    over = t.lineitem.where("l_returnflag <> 'N'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct("l_linenumber", "l_returnflag")).alias("x"))
    tier = F.coalesce("x.l_returnflag", "o_orderstatus").alias("tier")
    return t.orders.join(over, "o_orderkey", "left").groupBy(tier).agg(F.count("*").alias("n"))


@query("o061_book_status", "SELECT p_brand, count(*) AS docs, count(DISTINCT p_type) AS types, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS large, sum(CASE WHEN p_size <= 5 AND p_type = 'SMALL' THEN 1 ELSE 0 END)::BIGINT AS tiny FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("docs"), F.countDistinct("p_type").alias("types"), F.count_if(c("p_size") > 25).alias("large"), F.count_if((c("p_size") <= 5) & (c("p_type") == "SMALL")).alias("tiny"))


@query("o062_account_trend", "SELECT k, round(sum(v), 2) AS total, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last FROM (SELECT l_shipdate AS d, unnest([l_quantity, l_extendedprice]) AS v, unnest(['l_quantity', 'l_extendedprice']) AS k FROM lineitem) GROUP BY k")
def _(t):
    long = t.lineitem.unpivot(["l_shipdate"], ["l_quantity", "l_extendedprice"], "k", "v")
    return long.groupBy("k").agg(F.round(F.sum("v"), 2).alias("total"), *(F.date_format(f("l_shipdate"), "yyyy-MM-dd").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))))


@query("o063_speakers", "SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS asked, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS answered, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.count_if(c("role") == "user").alias("asked"), F.count_if(c("role") == "assistant").alias("answered"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("o064_kpi_row", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS rescued, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS suppressed FROM labels")
def _(t):
    return t.labels.agg(F.count("*").alias("n"), F.count_if((c("quality") == 0) & (c("toxic") == 0)).alias("rescued"), F.count_if((c("quality") == 1) & (c("toxic") == 1)).alias("suppressed"))


@query("o065_backfill_list", """WITH s AS (SELECT lower(p_brand) AS k, p_type AS spelling, count(*) AS n FROM part GROUP BY ALL)
SELECT s.k, (SELECT spelling FROM s x WHERE x.k = s.k ORDER BY n DESC, spelling LIMIT 1) AS spelling, sum(n)::BIGINT AS n, (SELECT string_agg(p_partkey, ',' ORDER BY p_partkey) FROM (SELECT p_partkey FROM part WHERE lower(p_brand) = s.k ORDER BY p_partkey LIMIT 5)) AS evidence FROM s GROUP BY s.k""")
def _(t):
    """Evidence is cut to five rows of a key before any list is made."""
    rows = t.part.select(F.lower("p_brand").alias("k"), "p_type", "p_partkey")
    spelled = rows.groupBy("k", "p_type").agg(F.count("*").alias("m"))
    best = spelled.groupBy("k").agg(F.min_by("p_type", F.struct(-c("m"), "p_type")).alias("spelling"), F.sum("m").alias("n"))
    five = records.top_per_key(rows, ["k"], ["p_partkey"], 5).groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("evidence"))
    return best.join(five, "k")


@query("o066_dead_platforms", "SELECT o_custkey AS platform, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS failed FROM orders GROUP BY 1 HAVING ok = 0 AND failed > 0")
def _(t):
    """A platform, here a customer, is dead if nothing of it went well and something failed."""
    out = t.orders.groupBy(c("o_custkey").alias("platform")).agg(F.count_if(c("o_orderstatus") == "F").alias("ok"), F.count_if(c("o_orderstatus") == "P").alias("failed"))
    return out.where("ok = 0 AND failed > 0")


@query("o067_source_share", "SELECT lang, max(n) AS top, sum(n)::BIGINT AS known, max(n) * 100 >= 90 * sum(n) AS warn FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def _(t):
    per = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(F.max("n").alias("top"), F.sum("n").alias("known"), (F.max("n") * 100 >= 90 * F.sum("n")).alias("warn"))


@query("o069_correlated_max", "SELECT o_orderkey, epoch_us(greatest(o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey))) AS last_us FROM orders")
def _(t):
    ship = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    return t.orders.join(ship, "o_orderkey", "left").select("o_orderkey", F.unix_micros(F.greatest("o_orderdate", "s").cast("timestamp")).alias("last_us"))


@query("o070_next_version", "SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS version FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("version"))


@query("o072_confusion", """SELECT quality, count(*) AS n, count(*) FILTER (WHERE verdict = quality) AS hits, count(*) FILTER (WHERE verdict IS NULL) AS undecided FROM (SELECT quality, CASE WHEN n_chars > 2000 THEN 1 WHEN n_chars < 300 THEN 0 END AS verdict FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def _(t):
    verdict = F.when(c("n_chars") > 2000, 1).when(c("n_chars") < 300, 0)
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("verdict", verdict)
    return rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(c("verdict") == c("quality")).alias("hits"), F.count_if(c("verdict").isNull()).alias("undecided"))


@query("o074_quantile_index", "SELECT event_type, list_sort(list(value))[(0.9 * count(*))::DECIMAL(18,4)::BIGINT * 0 + least(floor(count(*) * 9 / 10)::BIGINT, count(*) - 1) + 1] AS p90 FROM events GROUP BY 1")
def _(t):
    """The value at the place floor(0.9 n), by rank, so that no group has to fit into one list or task."""
    rows = ordered.in_order(t.events.select("event_type", "value", "event_id"), ["event_type"], [c("value").asc(), c("event_id").asc()])
    return rows.where(c("rank") == F.least(F.floor(c("size") * 9 / 10), c("size") - 1)).select("event_type", c("value").alias("p90"))


@query("o076_token_budget", "SELECT doc_id, spent >= 20000 AS over FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS spent FROM documents)")
def _(t):
    rows = ordered.in_order(t.documents.select("source", "doc_id", "n_chars"), ["source"], [c("doc_id").asc()], {"spent": c("n_chars")})
    return rows.select("doc_id", (F.coalesce(c("spent"), F.lit(0)) + F.coalesce(c("n_chars"), F.lit(0)) >= 20000).alias("over"))


@query("o078_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("o079_keep_first_exempt", "SELECT event_id FROM events WHERE event_type = 'error' OR event_id IN (SELECT min(event_id) FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type)")
def _(t):
    return records.keep_first(t.events, ["user_id", "event_type"], ["event_id"], c("event_type") == "error").select("event_id")


@query("o080_trace_outcomes", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS in_sweep FROM events),
k AS (SELECT *, CASE WHEN in_sweep > 1 THEN 'dup_in_sweep' WHEN value < 1 THEN 'not_image_only' WHEN ts < TIMESTAMP '2024-01-05' THEN 'before' WHEN ts >= TIMESTAMP '2024-01-25' THEN 'after' ELSE 'in' END AS o FROM s)
SELECT event_id, CASE WHEN o = 'in' THEN CASE WHEN row_number() OVER (PARTITION BY user_id, o ORDER BY event_type, event_id) > 1 THEN 'dup_across' ELSE 'in_window' END ELSE o END AS outcome FROM k""")
def _(t):
    first = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    o = F.when(c("f") > 1, "dup_in_sweep").when(c("value") < 1, "not_image_only").when(c("ts") < F.lit("2024-01-05").cast("timestamp_ntz"), "before").when(c("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"), "after").otherwise("in")
    rows = t.events.withColumn("f", first).withColumn("o", o)
    again = F.row_number().over(Window.partitionBy("user_id", "o").orderBy("event_type", "event_id")) > 1
    return rows.select("event_id", F.when(c("o") == "in", F.when(again, "dup_across").otherwise("in_window")).otherwise(c("o")).alias("outcome"))


@query("o081_source_stall", "SELECT event_type, epoch_us(max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-10')) AS before_us, epoch_us(min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-01-12')) AS after_us, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12') = 0 AS stalled FROM events GROUP BY 1")
def _(t):
    ts, a, b = c("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    return t.events.groupBy("event_type").agg(us(F.max(F.when(ts < a, ts))).alias("before_us"), us(F.min(F.when(ts >= b, ts))).alias("after_us"), (F.count_if((ts >= a) & (ts < b)) == 0).alias("stalled"))


@query("o082_group_caps", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 2")
def _(t):
    order = [F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return records.top_per_key(t.lineitem, ["l_orderkey", "l_returnflag"], order, 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("o083_stage_minutes", "SELECT event_id, greatest(coalesce(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), 0), 0) AS waited FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def _(t):
    s = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))
    rows = t.events.select("event_id", "user_id", s.alias("s"))
    return rows.select("event_id", F.greatest(F.coalesce(c("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id")), F.lit(0)), F.lit(0)).alias("waited"))


@query("o084_latest_passed", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    return records.latest(t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("o085_cover", "SELECT p_brand, min(struct_pack(a := CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END, b := p_size, k := p_partkey)).k AS cover FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.when(c("p_type") == "SMALL", 0).otherwise(1), "p_size", "p_partkey")).alias("cover"))


@query("o086_ledger_order", """SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN quality IS NULL THEN 2 ELSE 3 END, trunc(coalesce(n_chars, 0) / 1000.0 * 10) DESC, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    tier = F.when((c("quality") == 1) & (c("toxic") == 0), 0).when(c("quality") == 1, 1).when(c("quality").isNull(), 2).otherwise(3)
    heat = F.floor(F.coalesce("n_chars", F.lit(0)) / 1000.0 * 10)
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    placed = ordered.in_order(rows.select("doc_id", "lang", tier.alias("tier"), heat.alias("heat")), ["lang"], [c("tier").asc(), c("heat").desc(), c("doc_id").asc()])
    return placed.select("doc_id", (c("rank") + 1).alias("place"))


@query("o087_newest_nulls_last", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey LIMIT 50")
def _(t):
    return t.orders.orderBy(F.when(c("o_orderstatus") != "P", c("o_orderdate")).desc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey")


@query("o093_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 40")
def _(t):
    return t.documents.select("doc_id").orderBy(F.sha2(c("doc_id").cast("string"), 256), "doc_id").limit(40)


@query("o097_route_union", "SELECT doc_id, max(v) AS vector, max(l) AS label FROM (SELECT vec_id AS doc_id, true AS v, false AS l FROM embeddings WHERE label < 3 UNION ALL SELECT doc_id, false, true FROM labels) GROUP BY 1")
def _(t):
    a = t.embeddings.where("label < 3").select(c("vec_id").alias("doc_id"), F.lit(True).alias("vector"), F.lit(False).alias("label"))
    b = t.labels.select("doc_id", F.lit(False).alias("vector"), F.lit(True).alias("label"))
    return a.unionByName(b).groupBy("doc_id").agg(F.max("vector").alias("vector"), F.max("label").alias("label"))


@query("o098_exact_knn", """SELECT query_id, vec_id, similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 24""")
def _(t):
    queries = t.embeddings.where("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), "embedding")
    return search.nearest(queries, t.embeddings, 24)


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BM25 = rf"""
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, term, i, row_number() OVER (PARTITION BY item_id ORDER BY -length(term), i) AS r FROM (
  SELECT item_id, term, min(i) AS i FROM (SELECT item_id, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) AS i FROM benchmark) WHERE length(term) >= CASE WHEN regexp_matches(term, '[a-z0-9]') THEN 3 ELSE 2 END GROUP BY ALL)) WHERE r <= 8),
w AS MATERIALIZED (SELECT doc_id, {_TOK} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM w),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
st AS (SELECT count(*) AS total, avg(len(ws)) AS mean FROM w),
sc AS (SELECT term, doc_id, round(greatest(1e-6, ln((total - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf), st WHERE df <= greatest(total // 20, 16)),
hits AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 4)"""


def _terms(t):
    return t.benchmark.select("item_id", F.explode(X.key_phrases(X.tokens(c("text")))).alias("term"))


@query("o102_bm25_hits", f"WITH {_BM25} SELECT term, doc_id, score, rank FROM hits")
def _(t):
    terms = materialize(_terms(t).select("term").distinct(), "terms")
    return search.bm25_hits(t.documents, "doc_id", "text", terms)


@query("o170_similar_selected", f"WITH {_BM25} SELECT term, doc_id, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS rank FROM sc WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')) QUALIFY rank <= 4")
def _(t):
    """Phrase hits among some kinds of documents only, here two languages."""
    terms = materialize(_terms(t).select("term").distinct(), "terms")
    return search.bm25_hits(t.documents, "doc_id", "text", terms, only=c("lang").isin("fr", "de"))


@query("o187_picture_assignment")
def _(t):
    """Pictures of one item, here an order's lines, are matched by their prints; an item has few."""
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.struct(c("l_linenumber").alias("place"), c("l_partkey").alias("print")))).alias("a"),
        F.array_sort(F.collect_set(F.struct(c("l_linenumber").alias("place"), c("l_suppkey").alias("print")))).alias("b"),
    )
    return rows.select("l_orderkey", F.explode(records.assign_nearest(c("a"), c("b"), 6)).alias("x")).select("l_orderkey", "x.*")


@query("o103_document_frequency", rf"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1 HAVING df > greatest((SELECT count(*) FROM documents) // 20, 16)")
def _(t):
    return search.common_terms(t.documents, "text")


@query("o104_key_phrases", f"WITH {_BM25} SELECT item_id, string_agg(term, ' ' ORDER BY term) AS phrases FROM q GROUP BY 1")
def _(t):
    return _terms(t).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("phrases"))


def hybrid(t, limit: int = 10):
    """Phrase hits and vector neighbours of each benchmark item, fused by reciprocal ranks."""
    terms = materialize(_terms(t), "terms")
    hits = search.bm25_hits(t.documents, "doc_id", "text", terms)
    text = terms.join(hits, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("score"), 5).alias("score"))
    text = records.top_per_key(text, ["item_id"], [F.desc("score"), "doc_id"], 24)
    items = t.benchmark.select("item_id")
    queries = t.embeddings.join(items, c("vec_id") == c("item_id"), "left_semi").select(c("vec_id").alias("item_id"), "embedding")
    vector = search.nearest(queries, t.embeddings, 24, "item_id").withColumnRenamed("vec_id", "doc_id")
    return search.reciprocal_ranks([text, vector], ["item_id"], "doc_id", limit)


@query("o110_hybrid_fusion", f"""WITH {_BM25},
tx AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(score), 5) DESC, doc_id) AS rank FROM q JOIN hits USING (term) GROUP BY item_id, doc_id QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(sum(score), 5) DESC, doc_id) <= 24),
vx AS (SELECT b.item_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN embeddings v ON v.vec_id <> e.vec_id QUALIFY rank <= 24)
SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id) AS rank FROM (SELECT * FROM tx UNION ALL SELECT * FROM vx) GROUP BY item_id, doc_id QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id) <= 10""")
def _(t):
    return hybrid(t)


@query("o106_merge_routes", """WITH r AS (SELECT label AS g, vec_id AS k, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, 0 AS route FROM embeddings JOIN labels ON doc_id = vec_id WHERE quality = 1
UNION ALL SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC), 1 FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'
UNION ALL SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY n_chars DESC, vec_id), 2 FROM embeddings JOIN documents ON doc_id = vec_id WHERE n_chars > 1000),
m AS (SELECT g, k, count(*) AS routes, min(rank) AS best, min(route) AS route FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY g, CASE WHEN routes = 1 THEN route ELSE -1 END ORDER BY best, k) AS turn FROM m)
SELECT g, k, routes, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN routes = 1 THEN 1 ELSE 0 END, CASE WHEN routes > 1 THEN -routes END, CASE WHEN routes > 1 THEN best END, CASE WHEN routes = 1 THEN turn END, CASE WHEN routes = 1 THEN route END, k) AS place FROM n""")
def _(t):
    e = t.embeddings.select(c("label").alias("g"), c("vec_id").alias("k"))
    docs = t.documents.select(c("doc_id").alias("k"), "lang", "n_chars")
    lists = [(t.labels.where("quality = 1").select(c("doc_id").alias("k")), [F.asc("k")]), (docs.where("lang = 'en'"), [F.desc("k")]), (docs.where("n_chars > 1000"), [F.desc("n_chars"), F.asc("k")])]
    routes = [ordered.in_order(e.join(d, "k"), ["g"], o).withColumn("rank", c("rank") + 1) for d, o in lists]
    return search.merge_routes(routes, ["g"], "k")


@query("o105_route_budget", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM lineitem) WHERE spent < 60")
def _(t):
    return records.budget(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 60).select("l_orderkey", "l_linenumber")


@query("o116_availability", "SELECT source, string_agg(need, ',' ORDER BY need) AS missing FROM (SELECT source, need FROM (SELECT DISTINCT source FROM documents), (VALUES ('de'), ('en'), ('es'), ('fr'), ('ja')) v(need) EXCEPT SELECT source, lang FROM documents) GROUP BY 1")
def _(t):
    has = t.documents.groupBy("source").agg(F.collect_set("lang").alias("has"))
    need = F.array(*map(F.lit, ("de", "en", "es", "fr", "ja")))
    return has.select("source", F.array_join(F.array_sort(F.array_except(need, "has")), ",").alias("missing")).where("missing <> ''")


@query("o120_components", """WITH RECURSIVE e AS (SELECT p_partkey AS u, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS v FROM part UNION SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_type, p_size) FROM part), b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
r(node, reach) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, b.v FROM r JOIN b ON r.reach = b.u) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def _(t):
    """Parts of one brand and size, or of one name, type and size, belong together; each is linked to the first of its group."""
    edges = None
    for key in (["p_brand", "p_size"], ["p_name", "p_type", "p_size"]):
        first = t.part.groupBy(*key).agg(F.min("p_partkey").alias("b"))
        own = t.part.join(first, key).select(c("p_partkey").alias("a"), "b")
        edges = own if edges is None else edges.union(own)
    return graph.connected_components(edges, nodes=t.part.select(c("p_partkey").alias("node")))


@query("o118_capped_edges")
def _(t):
    """The order is a struct, so that nothing ranks all edges in one task."""
    order = F.struct((-c("l_quantity")).alias("q"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    edges = t.lineitem.select(c("l_partkey").alias("a"), (-c("l_suppkey") - 1).alias("b"), order.alias("rank"))
    return flow.capped_edges(edges, 5).select("a", "b", "rank.l_orderkey", "rank.l_linenumber")


@query("o121_representative", "SELECT source, lang, max(struct_pack(n := n_chars, k := -doc_id)).k * -1 AS doc_id FROM documents GROUP BY ALL")
def _(t):
    return t.documents.groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -c("doc_id"))).alias("doc_id"))


@query("o124_hamming", "SELECT a.l_orderkey AS item, a.l_linenumber AS i, b.l_linenumber AS j, bit_count(xor(a.l_partkey, b.l_partkey))::BIGINT AS distance FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE bit_count(xor(a.l_partkey, b.l_partkey)) <= 3")
def _(t):
    """Pictures of one item, here an order, are compared; an item has few."""
    a = t.lineitem.selectExpr("l_orderkey AS item", "l_linenumber AS i", "l_partkey AS x")
    pairs = a.join(a.selectExpr("item", "i AS j", "x AS y"), "item").where("i < j").withColumn("distance", F.bit_count(c("x").bitwiseXOR(c("y"))).cast("long"))
    return pairs.where("distance <= 3").select("item", "i", "j", "distance")


@query("o151_readiness", "SELECT l_orderkey AS run, l_linenumber AS task FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.l_returnflag <> 'A') GROUP BY ALL")
def _(t):
    tasks = t.lineitem.selectExpr("l_orderkey AS run", "l_linenumber AS task", "CASE l_returnflag WHEN 'R' THEN 'blocked' WHEN 'A' THEN 'passed' ELSE 'running' END AS status")
    deps = tasks.where("status = 'blocked'").select("run", "task").join(tasks.selectExpr("run", "task AS needs"), "run").where("needs < task")
    return flow.ready(tasks, deps).distinct()


@query("o152_run_done", "SELECT l_orderkey AS run, bool_and(l_linestatus = 'F') AND bool_or(l_returnflag = 'A') AS done FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(c("l_orderkey").alias("run")).agg((F.bool_and(c("l_linestatus") == "F") & F.bool_or(c("l_returnflag") == "A")).alias("done"))


@query("o158_overdue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + to_days(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 10 END) <= TIMESTAMP '1998-06-01'")
def _(t):
    days = F.when(c("o_orderpriority") == "1-URGENT", 1).otherwise(10)
    return t.orders.where((c("o_orderstatus") == "O") & (c("o_orderdate") + F.make_dt_interval(days) <= F.lit("1998-06-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("o164_snapshots_due", "SELECT o_orderkey, b AS bucket FROM orders, (VALUES (2), (24), (72), (168), (720)) v(b) WHERE o_orderdate <= TIMESTAMP '1997-03-01' - to_hours(b) AND o_orderdate > TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = b % 7 + 1)")
def _(t):
    buckets = F.explode(F.array(*map(F.lit, (2, 24, 72, 168, 720)))).alias("bucket")
    posts = t.orders.where("o_orderdate > TIMESTAMP_NTZ '1997-01-01'").select("o_orderkey", "o_orderdate", buckets)
    due = posts.where(c("o_orderdate") <= F.lit("1997-03-01").cast("timestamp_ntz") - F.make_dt_interval(hours=c("bucket")))
    have = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), c("l_linenumber").alias("n"))
    return due.withColumn("n", c("bucket") % 7 + 1).join(have, ["o_orderkey", "n"], "left_anti").select("o_orderkey", "bucket")


@query("o176_dag_layers", "WITH RECURSIVE r(node, layer) AS (SELECT 0::BIGINT, 0 UNION SELECT p_partkey, layer + 1 FROM r JOIN part ON p_partkey // 2 = node AND p_partkey > 0) SELECT node, max(layer) AS layer FROM r GROUP BY 1")
def _(t):
    return flow.layers(t.part.where("p_partkey > 0").selectExpr("p_partkey DIV 2 AS up", "p_partkey AS down"))


@query("o182_withdrawals", "SELECT o_custkey FROM orders GROUP BY 1 HAVING max(struct_pack(k := o_orderkey, s := o_orderstatus)).s <> 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    last = records.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").where("o_orderstatus <> 'F'")
    return last.select("o_custkey").join(t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("o185_rework_cap", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20') >= 3 AS hit FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def _(t):
    rows = t.events.where("ts <= TIMESTAMP_NTZ '2024-01-20 12:00:00'")
    return rows.groupBy("user_id").agg((F.count_if((c("event_type") == "error") & (c("ts") > F.lit("2024-01-20").cast("timestamp_ntz"))) >= 3).alias("hit"))
