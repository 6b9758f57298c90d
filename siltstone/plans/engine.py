"""Queries of phrases, segmentation, budgets over hits, sweeps, stage times and reminders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import automata, intake, measures, ordered, phrases, prints, records, reminders, reviews, search, stages
from siltstone.plans.registry import query
from siltstone.plans.relational import _BM25, _terms
from siltstone.session import materialize, scratch_dir
from siltstone.sources.versioned import VersionedTable, claim

c = F.col

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: An item's phrase: its longest word and those after it, two to five; at the end of the text, those before it.
_PHRASES = f"""b AS (SELECT item_id, {_WORDS} AS ws, 2 + item_id % 4 AS m FROM benchmark),
l AS (SELECT item_id, ws, m, arg_min(i, struct_pack(a := -length(w), b := i)) AS i FROM (SELECT item_id, ws, m, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b) WHERE length(w) >= CASE WHEN regexp_matches(w, '[a-z0-9]') THEN 3 ELSE 2 END GROUP BY ALL),
p AS (SELECT item_id AS phrase, m, ws[greatest(least(i, len(ws) - m + 1), 1):greatest(least(i, len(ws) - m + 1), 1) + m - 1] AS ws FROM l)"""
_HITS = f"""{_PHRASES},
w AS (SELECT doc_id, lang, {_WORDS} AS ws FROM documents),
k AS (SELECT doc_id, lang, len(ws) AS n, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT *, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT phrase, doc_id, lang, n, count(*) AS tf FROM g JOIN p ON w1 = ws[1] AND w2 = ws[2] AND (len(ws) < 3 OR w3 = ws[3]) AND (len(ws) < 4 OR w4 = ws[4]) AND (len(ws) < 5 OR w5 = ws[5]) GROUP BY ALL),
s AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM f), st AS (SELECT count(*) AS total, avg(len(ws)) AS mean FROM w),
r AS (SELECT phrase, doc_id, lang, tf AS occurrences, round(greatest(1e-6, ln((total - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6) AS score FROM s, st)"""


def _phrases(t):
    words = X.tokens(c("text"))
    rows = t.benchmark.select("item_id", words.alias("ws"), (2 + c("item_id") % 4).cast("int").alias("m"), F.get(X.key_phrases(words), F.lit(0)).alias("long")).where("long IS NOT NULL")
    start = F.greatest(F.least(F.array_position("ws", c("long")).cast("int"), F.size("ws") - c("m") + 1), F.lit(1))
    return materialize(rows.select(c("item_id").alias("phrase"), F.slice("ws", start, c("m")).alias("words")), "phrases")


@query("o102_phrase_hits", f"WITH {_HITS} SELECT phrase, doc_id, occurrences, score, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 4")
def _(t):
    """Phrases of two to five words, BM25 among the documents that have them, four hits each."""
    index = phrases.positional_index(t.documents, "doc_id", "text")
    return phrases.phrase_hits(index, "doc_id", _phrases(t))


@query("o170_phrase_hits_of_kinds", f"WITH {_HITS} SELECT phrase, doc_id, occurrences, score, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, doc_id) AS rank FROM r WHERE lang IN ('fr', 'de') QUALIFY rank <= 4")
def _(t):
    """The same among some kinds of documents, here two languages; scores stay those among all."""
    index = phrases.positional_index(t.documents, "doc_id", "text", carry=("lang",))
    return phrases.phrase_hits(index, "doc_id", _phrases(t), only=c("lang").isin("fr", "de"))


@query("o105_hit_budget", f"""WITH {_BM25}, h AS (SELECT item_id, q.term, count(*) AS n FROM q JOIN hits ON hits.term = q.term GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY -length(term), term) AS turn FROM h)
SELECT item_id, term, n, spent FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM x) WHERE spent < 16""")
def _(t):
    """Terms of an item, longest first, that are still asked for: those before them have fewer than 16 hits together."""
    terms = materialize(_terms(t), "terms")
    hits = search.bm25_hits(t.documents, "doc_id", "text", terms).groupBy("term").agg(F.count("*").alias("n"))
    rows = terms.join(hits, "term").select("item_id", "term", "n")
    spent = ordered.in_order(rows, ["item_id"], [F.length("term").desc(), c("term").asc()], {"spent": c("n")})
    return spent.where("spent < 16").select("item_id", "term", "n", "spent")


@query("o101_dictionary_words")
def _(t):
    """Documents without their white space, cut again by a dictionary of the items' words."""
    words = t.benchmark.select(F.explode(X.tokens(c("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("weight"))
    cut = automata.segment(t.documents, "doc_id", F.regexp_replace("text", r"\s+", ""), words)
    return cut.select("doc_id", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("words_md5"))


@query("o074_threshold_sweep", """WITH x AS (SELECT n_chars // 100 AS s, quality AS p FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
t AS (SELECT DISTINCT s AS threshold FROM x), a AS (SELECT sum(p)::BIGINT AS pos, count(*) AS n FROM x),
k AS (SELECT threshold, sum(p)::BIGINT AS tp, sum(1 - p)::BIGINT AS fp FROM t JOIN x ON s >= threshold GROUP BY 1),
f AS (SELECT threshold, tp, fp, tp / greatest(pos, 1) AS recall, tp / greatest(tp + fp, 1) AS precision, 1 - (tp + fp) / n AS dropped FROM k, a),
g AS (SELECT *, round(CASE WHEN tp = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END, 9) AS f FROM f)
SELECT threshold, tp, fp, round(recall, 9) AS recall, round(precision, 9) AS precision, f, round(dropped, 9) AS dropped, row_number() OVER (ORDER BY f DESC, threshold) = 1 AS best FROM g""")
def _(t):
    """Every length in hundreds of characters as a threshold for good quality, with its F2."""
    rows = t.documents.select("doc_id", F.floor(c("n_chars") / 100).alias("score")).join(t.labels.select("doc_id", "quality"), "doc_id")
    return stages.threshold_sweep(rows, "score", "quality")


@query("o083_stage_times", """WITH e AS (SELECT user_id AS task, event_id AS id, event_type AS kind, epoch_us(ts) AS us FROM events), d AS (SELECT * FROM e WHERE kind = 'signup'), o AS (SELECT * FROM e WHERE kind = 'purchase'),
w AS (SELECT o.task, o.us, d.us AS dus FROM o ASOF LEFT JOIN d ON o.task = d.task AND o.id > d.id),
a AS (SELECT d.task, d.id, d.us, o.id AS oid, o.us AS ous FROM d ASOF LEFT JOIN o ON d.task = o.task AND d.id > o.id),
b AS (SELECT a.*, p.id AS pid FROM a ASOF LEFT JOIN d p ON a.task = p.task AND a.id > p.id),
r AS (SELECT r.task, r.id, r.kind, r.us, o.id AS version, o.us AS ous FROM (SELECT * FROM e WHERE kind IN ('click', 'error')) r ASOF JOIN o ON r.task = o.task AND r.id > o.id),
l AS (SELECT *, coalesce(lag(us) OVER (PARTITION BY version ORDER BY id), ous) AS prev FROM r),
x AS (SELECT task, 1 AS n, coalesce(greatest((us - dus) // 60000000, 0), 0) AS work, 0 AS hub, 0 AS van FROM w
UNION ALL SELECT task, 0, 0, CASE WHEN oid IS NOT NULL AND (pid IS NULL OR oid > pid) THEN greatest((us - ous) // 60000000, 0) ELSE 0 END, 0 FROM b
UNION ALL SELECT task, 0, 0, CASE WHEN kind = 'error' THEN greatest((us - prev) // 60000000, 0) ELSE 0 END, CASE WHEN kind = 'click' THEN greatest((us - prev) // 60000000, 0) ELSE 0 END FROM l
UNION ALL SELECT task, 0, 0, 0, 0 FROM e WHERE kind = 'view')
SELECT task, sum(n)::BIGINT AS versions, sum(work)::BIGINT AS work_min, sum(hub)::BIGINT AS hub_min, sum(van)::BIGINT AS van_min, greatest(sum(n) - 1, 0)::BIGINT AS reworks FROM x GROUP BY 1""")
def _(t):
    """Users as tasks: sign-ups dispatch, views supplement, purchases are versions; clicks are relayed reviews, errors the hub's."""
    rows = t.events.select(c("user_id").alias("task"), c("event_id").alias("id"), "event_type", c("ts").cast("timestamp").alias("at"))
    kind = F.when(c("event_type") == "signup", "dispatch").when(c("event_type") == "view", "supplement").otherwise("output")
    given = rows.where("event_type IN ('signup', 'view', 'purchase')").select("task", "id", kind.alias("kind"), "at")
    judged = rows.where("event_type IN ('click', 'error')").select("task", "id", (c("event_type") == "click").alias("relayed"), "at")
    version = given.where("kind = 'output'").select("task", "id", c("id").alias("deliverable"))
    judged = ordered.as_of(judged, version, ["task"], "id", ["deliverable"], strict=True).where("deliverable IS NOT NULL")
    return stages.stage_times(given, judged.select("id", "deliverable", "relayed", "at"))


def changes(t):
    """Events as changes of a user's task: a sign-up dispatches it, due in a day; clicks and views are activity."""
    status = F.when(c("event_type") == "signup", "dispatched").when(c("event_type").isin("click", "view"), "in_progress").when(c("event_type") == "error", "returned").otherwise("done")
    at = F.date_trunc("millisecond", c("ts").cast("timestamp"))
    return t.events.select(c("user_id").cast("long").alias("task"), at.alias("at"), status.alias("status"), F.when(status != "done", F.date_trunc("day", at) + F.expr("INTERVAL 1 DAY")).alias("due_at"))


@query("o158_reminders", """WITH e AS (SELECT user_id AS task, date_trunc('millisecond', ts) AS t0, CASE event_type WHEN 'signup' THEN 'dispatched' WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'in_progress' WHEN 'error' THEN 'returned' ELSE 'done' END AS status FROM events),
o AS (SELECT task, t0, max(status) AS status FROM e GROUP BY 1, 2), x AS (SELECT *, CASE WHEN status <> 'done' THEN date_trunc('day', t0) + INTERVAL 1 DAY END AS due_at, lead(t0) OVER (PARTITION BY task ORDER BY t0) AS t1 FROM o),
r AS (SELECT task, t1, 'ack' AS kind, t0 AS since, t0 + INTERVAL 90 MINUTE AS due FROM x WHERE status = 'dispatched' UNION ALL SELECT task, t1, 'escalate', t0, t0 + INTERVAL 180 MINUTE FROM x WHERE status = 'dispatched'
UNION ALL SELECT task, t1, 'idle', t0, t0 + INTERVAL 240 MINUTE FROM x WHERE status = 'in_progress' UNION ALL SELECT task, t1, 'overdue', due_at, greatest(due_at, t0) FROM x WHERE status IN ('dispatched', 'in_progress', 'returned') AND due_at IS NOT NULL)
SELECT task, kind, epoch_ms(since) AS since_ms, epoch_ms(min(due)) AS due_ms FROM r WHERE due <= TIMESTAMP '2024-01-31' AND (t1 IS NULL OR t1 > due) GROUP BY task, kind, since""")
def _(t):
    found = reminders.reminders(changes(t), F.lit("2024-01-31").cast("timestamp"), reminders.Limits(90, 240, 2))
    return found.select("task", "kind", F.unix_millis("since").alias("since_ms"), F.unix_millis("due").alias("due_ms"))


@query("o024_reconcile_books", """WITH l AS (SELECT doc_id AS k, source AS b, md5(text || CASE WHEN quality = 1 THEN '' ELSE '*' END) AS h FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id + 10000000000, source, md5(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
o AS (SELECT doc_id AS k, source AS b, md5(text) AS h FROM documents),
j AS (SELECT coalesce(o.k, l.k) AS k, o.h AS old, l.h AS new, CASE WHEN o.k IS NULL THEN 'insert' WHEN l.k IS NULL THEN CASE WHEN o.b IN (SELECT b FROM l) THEN 'delete' ELSE 'other' END WHEN o.h = l.h THEN 'same' ELSE 'update' END AS action FROM o FULL JOIN l ON o.k = l.k)
SELECT action, k AS doc_id, CASE WHEN action = 'delete' THEN old ELSE new END AS hash FROM j WHERE action <> 'other' UNION ALL
SELECT DISTINCT 'orphan', NULL, old FROM j WHERE action IN ('delete', 'update') AND old NOT IN (SELECT CASE WHEN action = 'other' THEN old ELSE new END FROM j WHERE action <> 'delete')""")
def _(t):
    """Sources as books, labels as a manifest that lists some documents, some of them changed, and some new ones."""
    docs = t.documents.select("doc_id", "source", "text")
    listed = docs.join(t.labels, "doc_id")
    text = F.when(c("quality") == 1, c("text")).otherwise(F.concat("text", F.lit("*")))
    lines = listed.select("doc_id", "source", F.md5(text).alias("hash")).unionByName(listed.where("toxic = 1").select((c("doc_id") + 10000000000).alias("doc_id"), "source", F.md5("text").alias("hash")))
    return records.reconcile(docs.select("doc_id", "source", F.md5("text").alias("hash")), lines, "source", "doc_id", "hash")


@query("o026_claims_in_turn", """SELECT o_orderkey AS id, CASE WHEN r <= 100 THEN 'c' ELSE 'b' END AS owner, CASE WHEN r <= 100 THEN epoch_us(TIMESTAMP '1998-01-01 00:06:00') ELSE epoch_us(TIMESTAMP '1998-01-01 00:02:00') END AS claimed_us
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01') WHERE r <= 200""")
def _(t):
    """All orders as an outbox: a and b claim a hundred each, and c those of a, whose lease of five minutes has ended."""
    rows = t.orders.select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "P", "pending").otherwise("sent").alias("status"), c("o_orderdate").cast("timestamp").alias("next_at"), F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("string").alias("owner"))
    table = VersionedTable(t.spark, f"{scratch_dir(t.spark)}/outbox-{uuid.uuid4().hex}", ["id"])
    table.create(rows)
    for owner, minute in (("a", 1), ("b", 2), ("c", 6)):
        claim(table, owner, F.lit(f"1998-01-01 00:0{minute}:00").cast("timestamp"), 100, 5)
    return table.read().where("owner IS NOT NULL").select("id", "owner", F.unix_micros("claimed_at").alias("claimed_us"))


_CELLS = "list_transform(range(72), lambda i: length(substr({0}, 1 + len0 * i // 72, len0 * (i + 1) // 72 - len0 * i // 72)) - length(replace(substr({0}, 1 + len0 * i // 72, len0 * (i + 1) // 72 - len0 * i // 72), 'e', '')))"
_BITS = "list_reduce(list_prepend(0::UBIGINT, list_transform(range(64), lambda i: CASE WHEN c[i + i // 8 + 1] > c[i + i // 8 + 2] THEN 1::UBIGINT ELSE 0::UBIGINT END)), lambda a, b: a * 2 + b)"


@query("o124_near_prints", f"""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, text AS s, n AS len0 FROM t UNION ALL SELECT doc_id, substr(text, 1 + floor(n * 0.1)::INT, floor(n * 0.9)::INT - floor(n * 0.1)::INT), floor(n * 0.9)::INT - floor(n * 0.1)::INT FROM t),
c AS (SELECT doc_id, {_CELLS.format("s")} AS c FROM x), p AS (SELECT doc_id, {_BITS} AS p FROM c), f AS (SELECT p, min(doc_id) AS first FROM p GROUP BY 1)
SELECT a.first AS a, b.first AS b, min(bit_count(xor(a.p, b.p))) AS distance FROM f a JOIN f b ON a.first < b.first AND a.p <> b.p AND bit_count(xor(a.p, b.p)) <= 6 GROUP BY ALL""")
def _(t):
    """Texts as pictures of a letter's frequency, whole and without their margins: prints within 6 bits, by the first of each print."""
    text = c("text")
    cells = F.array(prints.text_cells(text, "e"), prints.text_cells(text, "e", 0.1, 0.9))
    rows = t.documents.where("text IS NOT NULL").select("doc_id", F.explode(cells).alias("cells")).select("doc_id", prints.row_print(c("cells")).alias("print"))
    return prints.near_prints(rows, 6, "doc_id", "print")[0]


@query("o142_review_tiers", """WITH o AS (SELECT o_orderkey, 'c' || o_custkey || '-' || substr(sha256(o_orderkey::VARCHAR), 1, 6) AS entry, o_orderkey % 4 AS k, CASE o_orderstatus WHEN 'F' THEN '继续' WHEN 'O' THEN '备选' ELSE '停止' END AS w, CASE o_orderstatus WHEN 'F' THEN 'recommend' WHEN 'O' THEN 'alternate' ELSE 'not_recommend' END AS e FROM orders)
SELECT o_orderkey AS review_id, 0 AS place, entry, CASE k WHEN 3 THEN 'pending_check' ELSE e END AS tier, CASE k WHEN 0 THEN w || '；备注' WHEN 2 THEN '的 tier=' || e ELSE '此前无变化。隔离待核，保留素材' END AS note FROM o WHERE k <> 1""")
def _(t):
    """Reviews about one entry for each order, whose key they give by its last six digits only: a tier after it, one before it (no statement), one by name, and one in a later sentence."""
    six = F.substring(F.sha2(c("o_orderkey").cast("string"), 256), 1, 6)
    word = F.when(c("o_orderstatus") == "F", "继续").when(c("o_orderstatus") == "O", "备选").otherwise("停止")
    name = F.when(c("o_orderstatus") == "F", "recommend").when(c("o_orderstatus") == "O", "alternate").otherwise("not_recommend")
    kind = c("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(six, F.lit("="), word, F.lit("；备注"))).when(kind == 1, F.concat(F.lit("停止针对 "), six, F.lit(" 再深核")))
    text = text.when(kind == 2, F.concat(six, F.lit(" 的 tier="), name)).otherwise(F.concat(F.lit("1. "), six, F.lit("：此前无变化。隔离待核，保留素材")))
    given = t.orders.select(c("o_orderkey").alias("review_id"), c("o_orderkey").alias("run"), text.alias("text"))
    entries = t.orders.select(c("o_orderkey").alias("run"), F.concat(F.lit("c"), c("o_custkey").cast("string"), F.lit("-"), six).alias("entry"))
    return reviews.review_tiers(reviews.spelled_out(given, entries, "run"))


@query("o156_intake_checks", """WITH runs AS (SELECT c_custkey AS run, TIMESTAMP '1994-01-01' AS a, TIMESTAMP '1997-12-31' AS z FROM customer),
sources AS (SELECT DISTINCT event_type AS p, 'k' || event_id % 3 AS k, event_id % 3 = 0 AS req FROM events WHERE event_id % 3 < 2 UNION SELECT 'view', 'channel', false),
sweeps AS (SELECT user_id AS run, 's' || event_id % 6 AS sk, event_type AS p, 'k' || event_id % 3 AS k, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'r1' ELSE 'r2' END AS role, CASE WHEN event_type = 'view' THEN 'csw_api' ELSE 'web' END AS tool, CASE WHEN value < 20 OR event_type = 'error' THEN 'failed' ELSE 'ok' END AS result, floor(value / 10)::BIGINT AS v FROM events),
items AS (SELECT o_custkey AS run, o_orderkey AS k, o_orderstatus = 'P' AS dropped, CASE WHEN o_orderkey % 7 = 0 THEN 'm' WHEN o_orderkey % 11 = 0 THEN 'u' ELSE 'd' END AS kind, o_orderdate AS d, o_orderkey % 5 = 0 AS unnoted, o_orderkey % 3 = 0 AS bad_url, o_orderkey % 13 = 0 AS early, 's' || o_orderkey % 6 AS via FROM orders),
traces AS (SELECT o_custkey AS run, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0),
judged AS (SELECT doc_id % 200 AS run, CASE WHEN quality = 1 THEN 'r1' ELSE '' END AS role, CASE WHEN toxic = 1 THEN 'pending_check' ELSE 'recommend' END AS tier, toxic = 0 AND quality = 1 AS seen FROM labels),
roles AS (SELECT DISTINCT run, role FROM judged WHERE role <> ''),
own AS (SELECT * FROM sweeps s WHERE role = '' OR run NOT IN (SELECT run FROM roles) OR EXISTS (SELECT 1 FROM roles r WHERE r.run = s.run AND r.role = s.role)),
keyed AS (SELECT s.run, s.p, CASE WHEN e.p IS NULL AND h.p IS NOT NULL THEN 'channel' ELSE s.k END AS k, coalesce(e.req, h.req) AS req FROM sweeps s LEFT JOIN sources e ON e.p = s.p AND e.k = s.k LEFT JOIN sources h ON h.p = s.p AND h.k = 'channel' WHERE e.p IS NOT NULL OR h.p IS NOT NULL),
cov AS (SELECT run, count(*) FILTER (req) AS rs, count(*) FILTER (NOT req) AS os FROM (SELECT DISTINCT run, p, k, req FROM keyed) GROUP BY 1),
tot AS (SELECT count(*) AS ns, count(*) FILTER (req) AS nr FROM sources),
sw AS (SELECT run, count(*) AS n, sum(v) AS rev, sum(v // 3) AS unrev, sum(v // 2) AS cor FROM sweeps GROUP BY 1),
ow AS (SELECT run, count(*) AS n, count(*) FILTER (tool = 'csw_api') AS api, coalesce(sum(v) FILTER (tool = 'csw_api'), 0) AS uniq, coalesce(sum(v // 3) FILTER (tool = 'csw_api'), 0) AS op FROM own GROUP BY 1),
de AS (SELECT run, count(*) AS n FROM (SELECT run, p FROM own GROUP BY 1, 2 HAVING count(*) FILTER (result <> 'failed') = 0) GROUP BY 1),
ju AS (SELECT run, count(*) AS n, count(*) FILTER (NOT seen) AS us, count(*) FILTER (NOT seen AND tier <> 'pending_check') AS ub FROM judged GROUP BY 1),
it AS (SELECT i.run, count(*) AS n, count(*) FILTER (kind <> 'd') AS odd, count(*) FILTER (kind = 'd' AND (d < a OR d > z OR early)) AS bad, count(*) FILTER (dropped AND k NOT IN (SELECT k FROM traces)) AS un, count(*) FILTER (NOT dropped AND unnoted) AS nn, count(*) FILTER (NOT dropped AND bad_url) AS ne FROM items i JOIN runs USING (run) GROUP BY 1),
tr AS (SELECT run, count(*) AS n FROM traces GROUP BY 1),
pl AS (SELECT run, sk, max(p) AS p FROM own GROUP BY 1, 2), sp AS (SELECT run, sum(n) AS known, max(n) AS most FROM (SELECT i.run, p, count(*) AS n FROM items i JOIN pl ON pl.run = i.run AND pl.sk = i.via GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT runs.run, ns, nr, coalesce(rs, 0) AS rs, coalesce(os, 0) AS os, coalesce(sw.n, 0) AS n_sweeps, coalesce(rev, 0) AS rev, coalesce(unrev, 0) AS unrev, coalesce(cor, 0) AS cor, coalesce(ow.n, 0) AS n_own, coalesce(api, 0) AS api, coalesce(uniq, 0) AS uniq, coalesce(op, 0) AS op, coalesce(de.n, 0) AS n_dead, coalesce(ju.n, 0) AS nj, coalesce(us, 0) AS us, coalesce(ub, 0) AS ub,
  coalesce(it.n, 0) AS ni, coalesce(odd, 0) AS odd, coalesce(bad, 0) AS bad, coalesce(un, 0) AS un, coalesce(nn, 0) AS nn, coalesce(ne, 0) AS ne, coalesce(tr.n, 0) AS nt, coalesce(known, 0) AS known, coalesce(most, 0) AS most
  FROM runs CROSS JOIN tot LEFT JOIN cov USING (run) LEFT JOIN sw USING (run) LEFT JOIN ow USING (run) LEFT JOIN de USING (run) LEFT JOIN ju USING (run) LEFT JOIN it USING (run) LEFT JOIN tr USING (run) LEFT JOIN sp USING (run)),
y AS (SELECT *, greatest(rev - cor, 0) - ni AS gap, greatest(uniq - nj, 0) AS short FROM x)
SELECT run, 'coverage' AS check, CASE WHEN n_sweeps = 0 THEN 'skipped' WHEN nr > rs THEN 'failed' WHEN ns > nr AND os * 100 // (ns - nr) < 60 THEN 'warn' ELSE 'ok' END AS state, (nr - rs)::BIGINT AS n FROM y
UNION ALL SELECT run, 'judged_all', CASE WHEN api = 0 THEN 'skipped' WHEN op > 0 OR short > 0 THEN 'failed' ELSE 'ok' END, CASE WHEN op > 0 THEN op ELSE short END::BIGINT FROM y WHERE nj > 0
UNION ALL SELECT run, 'pending_consistent', CASE WHEN ub > 0 THEN 'failed' WHEN us > 0 THEN 'warn' ELSE 'ok' END, ub::BIGINT FROM y WHERE nj > 0
UNION ALL SELECT run, 'yield', CASE WHEN n_sweeps = 0 OR (rev = 0 AND unrev = 0) OR (gap > 0 AND nt = 0) THEN 'skipped' WHEN gap > 0 THEN 'failed' WHEN unrev > 0 THEN 'warn' ELSE 'ok' END, greatest(gap, 0)::BIGINT FROM y WHERE nj = 0
UNION ALL SELECT run, 'window', CASE WHEN ni = 0 THEN 'skipped' WHEN bad > 0 THEN 'failed' WHEN odd > 0 THEN 'warn' ELSE 'ok' END, bad::BIGINT FROM y
UNION ALL SELECT run, 'drop_explained', CASE WHEN nt = 0 THEN 'skipped' WHEN un > 0 THEN 'failed' ELSE 'ok' END, un::BIGINT FROM y
UNION ALL SELECT run, 'dedup_noted', CASE WHEN ni = 0 THEN 'skipped' WHEN nn > 0 THEN 'warn' ELSE 'ok' END, nn::BIGINT FROM y
UNION ALL SELECT run, 'evidence', CASE WHEN ni = 0 THEN 'skipped' WHEN ne > 0 THEN 'warn' ELSE 'ok' END, ne::BIGINT FROM y
UNION ALL SELECT run, 'fallback', CASE WHEN n_own = 0 THEN 'skipped' WHEN n_dead > 0 THEN 'failed' ELSE 'ok' END, n_dead::BIGINT FROM y
UNION ALL SELECT run, 'spread', CASE WHEN known = 0 THEN 'skipped' WHEN most * 100 // known >= 90 AND ns > 1 THEN 'warn' ELSE 'ok' END, CASE WHEN known > 0 AND most * 100 // known >= 90 AND ns > 1 THEN most ELSE 0 END::BIGINT FROM y""")
def _(t):
    """Customers as runs, their orders as items, a user's events as sweeps, labels as judgements; every check of the intake."""
    e, k, day = c("event_id"), c("o_orderkey"), F.lit("1994-01-01").cast("timestamp")
    runs = t.customer.select(c("c_custkey").alias("run"), day.alias("start"), F.lit("1997-12-31").cast("timestamp").alias("end"))
    key = F.concat(F.lit("k"), (e % 3).cast("string"))
    sources = t.events.where("event_id % 3 < 2").select(c("event_type").alias("platform"), key.alias("source_key"), (e % 3 == 0).alias("required")).distinct()
    sources = sources.union(t.events.where("event_type = 'view'").select(F.lit("view"), F.lit("channel"), F.lit(False)).distinct())
    v = F.floor(c("value") / 10)
    sweeps = t.events.select(
        c("user_id").alias("run"), F.concat(F.lit("s"), (e % 6).cast("string")).alias("sweep_key"), c("event_type").alias("platform"), key.alias("source_key"),
        F.when(e % 4 == 0, "").when(e % 4 == 1, "r1").otherwise("r2").alias("role"), F.when(c("event_type") == "view", "csw_api").otherwise("web").alias("tool"),
        F.when((c("value") < 20) | (c("event_type") == "error"), "failed").otherwise("ok").alias("result"), v.alias("found"), v.alias("in_window"), v.alias("reviewed"), F.floor(v / 3).alias("unreviewed"), F.floor(v / 2).alias("corroborated"))
    date = c("o_orderdate").cast("timestamp")
    items = t.orders.select(
        c("o_custkey").alias("run"), k.alias("item_key"), F.when(c("o_orderstatus") == "P", "dropped").otherwise("kept").alias("status"),
        F.when(k % 7 == 0, " ").when(k % 11 == 0, "soon").otherwise(date.cast("string")).alias("published_at"), F.when(k % 13 == 0, (date - F.expr("INTERVAL 1 DAY")).cast("string")).otherwise((date + F.expr("INTERVAL 1 DAY")).cast("string")).alias("fetched_at"),
        F.when(k % 5 != 0, "seen").alias("dedup_note"), F.when(k % 3 == 0, "http://x/1").otherwise(" https://x/1").alias("evidence_url"), F.concat(F.lit("s"), (k % 6).cast("string")).alias("via"))
    traces = t.orders.where("o_orderkey % 2 = 0").select(c("o_custkey").alias("run"), k.alias("item_key"), F.lit("why").alias("reason"))
    judged = t.labels.select((c("doc_id") % 200).alias("run"), c("doc_id").alias("candidate_key"), F.when(c("quality") == 1, "r1").otherwise("").alias("role"), F.when(c("toxic") == 1, "pending_check").otherwise("recommend").alias("tier"), ((c("toxic") == 0) & (c("quality") == 1)).alias("image_seen"))
    return intake.intake_checks(runs, sources, sweeps, items, traces, judged)


@query("o073_recall_by_route", """WITH q AS (SELECT vec_id AS query, label, embedding, source FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
v AS (SELECT q.query, e.vec_id AS key, row_number() OVER (PARTITION BY q.query ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.query QUALIFY rank <= 24),
s AS (SELECT q.query, d.doc_id AS key, row_number() OVER (PARTITION BY q.query ORDER BY d.doc_id) AS rank FROM q JOIN documents d ON d.source = q.source AND d.doc_id <> q.query QUALIFY rank <= 24),
p AS (SELECT query, key, string_agg(r, ',' ORDER BY r) AS routes, min(rank) AS best FROM (SELECT *, 'vector' AS r FROM v UNION ALL SELECT *, 'source' FROM s) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY best, key) AS place FROM p),
t AS (SELECT q.query, e.vec_id AS key FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.query), f AS (SELECT query, min(place) AS place, arg_min(routes, place) AS routes FROM o JOIN t USING (query, key) GROUP BY 1),
x AS (SELECT * FROM (SELECT DISTINCT query FROM t) LEFT JOIN f USING (query), (VALUES (1), (5), (10), (24)) k(k))
SELECT k, count(*) AS n, count(*) FILTER (place <= k) AS hits, round(count(*) FILTER (place <= k) / count(*), 9) AS rate, count(*) FILTER (place <= k AND routes = 'vector') AS only_vector, count(*) FILTER (place <= k AND routes = 'source') AS only_source FROM x GROUP BY 1""")
def _(t):
    """Vectors of the query set by two routes, near vectors and documents of the source; right are vectors of the label."""
    docs = t.documents.select("doc_id", "source")
    asked = t.embeddings.where("vec_id % 100 = 0").join(docs, c("doc_id") == c("vec_id")).select(c("vec_id").alias("query"), "label", "source", "embedding")
    near = search.nearest(asked.select(c("query").alias("query_id"), "embedding"), t.embeddings, 24).select(c("query_id").alias("query"), c("vec_id").alias("key"), "rank")
    first = records.top_per_key(docs, ["source"], ["doc_id"], 25).drop("rank")  # without a query's own row at least 24
    same = asked.select("query", "source").join(first, "source").where("doc_id <> query")
    same = records.top_per_key(same, ["query"], ["doc_id"], 24).select("query", c("doc_id").alias("key"), "rank")
    pool = materialize(measures.pooled({"vector": near, "source": same}), "pool")
    labels = t.embeddings.select("vec_id", "label")
    # Of a query's targets count those in its pool, and whether there is one at all, for which two of each label are asked.
    found = pool.select("query", "key").join(asked.select("query", "label"), "query").join(labels.withColumnRenamed("vec_id", "key"), ["key", "label"])
    some = asked.select("query", "label").join(records.top_per_key(labels, ["label"], ["vec_id"], 2).drop("rank"), "label").where("vec_id <> query")
    right = found.select("query", "key").union(some.select("query", c("vec_id").alias("key")))
    return measures.recall_by_route(pool, right, [1, 5, 10, 24], ["vector", "source"])


@query("o080_traced_rows", """WITH x AS (SELECT event_type AS sweep, event_id AS pos, user_id * 10 + event_id % 10 AS id, value >= 1 AS image_only, CASE WHEN event_id % 9 > 0 THEN ts END AS t0 FROM events),
k AS (SELECT *, CASE WHEN pos > min(pos) OVER (PARTITION BY sweep, id) THEN 'dup_in_sweep' WHEN NOT image_only THEN 'not_image_only' WHEN t0 IS NULL THEN 'no_time' WHEN t0 < TIMESTAMP '2024-01-05' THEN 'before' WHEN t0 >= TIMESTAMP '2024-01-25' THEN 'after' ELSE 'in_window' END AS kind FROM x),
f AS (SELECT id, min(struct_pack(s := sweep, p := pos)) AS place FROM k WHERE kind = 'in_window' GROUP BY 1)
SELECT pos AS event_id, CASE WHEN kind = 'in_window' AND (sweep > f.place.s OR pos > f.place.p) AND (sweep <> f.place.s OR pos <> f.place.p) THEN 'dup_across' ELSE kind END AS outcome,
CASE WHEN kind = 'in_window' AND (sweep <> f.place.s OR pos <> f.place.p) THEN 'e' || f.place.p END AS dup_of FROM k LEFT JOIN f USING (id)""")
def _(t):
    """Events as fetched rows: a type is a sweep, a user and a digit an entry; some rows have no time."""
    e = c("event_id")
    rows = t.events.select(c("event_type").alias("sweep"), e.alias("pos"), (c("user_id") * 10 + e % 10).alias("id"), F.concat(F.lit("e"), e.cast("string")).alias("key"), (c("value") >= 1).alias("image_only"), F.when(e % 9 > 0, c("ts").cast("timestamp")).alias("at"))
    out = measures.traced(rows, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp"))
    return out.select(c("pos").alias("event_id"), "outcome", "dup_of")


@query("o081_stalled_sources", """WITH w AS (SELECT user_id AS sweep, TIMESTAMP '2024-01-10' AS a, TIMESTAMP '2024-01-10' + CASE WHEN user_id % 3 = 0 THEN INTERVAL 4 HOUR ELSE INTERVAL 9 HOUR END AS z, count(*) FILTER (event_type <> 'error') AS found, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS result FROM events GROUP BY 1),
r AS (SELECT user_id AS sweep, ts FROM events WHERE event_type <> 'error')
SELECT w.sweep, epoch_us(max(ts) FILTER (ts < a)) AS before_us, epoch_us(min(ts) FILTER (ts >= z)) AS after_us, CASE WHEN found = 0 THEN 'nothing_returned' WHEN max(ts) FILTER (ts < a) IS NOT NULL AND min(ts) FILTER (ts >= z) IS NOT NULL THEN 'interrupted' WHEN max(ts) FILTER (ts < a) IS NOT NULL THEN 'stopped' ELSE 'outside' END AS reason
FROM w LEFT JOIN r ON r.sweep = w.sweep WHERE result = 'ok' AND z - a >= INTERVAL 6 HOUR GROUP BY w.sweep, found HAVING found = 0 OR count(*) FILTER (ts >= a AND ts < z) = 0""")
def _(t):
    """Users as sweeps of one window, of four or nine hours, whose events are what the source returned."""
    u, start = c("user_id"), F.lit("2024-01-10").cast("timestamp")
    hours = F.when(u % 3 == 0, F.expr("INTERVAL 4 HOUR")).otherwise(F.expr("INTERVAL 9 HOUR"))
    sweeps = t.events.groupBy("user_id").agg(F.count_if(c("event_type") != "error").alias("found"))
    sweeps = sweeps.select(u.alias("sweep"), start.alias("start"), (start + hours).alias("end"), "found", F.lit(0).alias("in_window"), F.when(u % 7 == 0, "failed").otherwise("ok").alias("result"))
    returned = t.events.where("event_type <> 'error'").select(u.alias("sweep"), c("ts").cast("timestamp").alias("ingested_at"))
    out = measures.stalled_sources(sweeps, returned)
    return out.select("sweep", F.unix_micros("last_before").alias("before_us"), F.unix_micros("first_after").alias("after_us"), "reason")


_TIER_SQL = "CASE WHEN {0} % 5 = 0 THEN NULL WHEN {0} % 5 = 1 THEN 'recommend' WHEN {0} % 5 = 2 THEN 'alternate' WHEN {0} % 5 = 3 THEN 'not_recommend' ELSE 'pending_check' END"


@query("o072_verdicts_and_consistency", f"""WITH x AS (SELECT CASE WHEN quality = 1 THEN 'adopted' WHEN toxic = 1 THEN 'dropped' ELSE 'rejected' END AS truth, {_TIER_SQL.format("(n_chars // 7)")} AS first, {_TIER_SQL.format("(n_chars // 10)")} AS second FROM labels JOIN documents USING (doc_id)),
y AS (SELECT *, first IS NOT NULL AND first <> 'pending_check' AS d, CASE WHEN truth = 'adopted' THEN first IN ('recommend', 'alternate') ELSE first = 'not_recommend' END AS r FROM x)
SELECT truth, count(*) AS n, count(*) FILTER (d AND r) AS "right", count(*) FILTER (d AND NOT r) AS wrong, count(*) FILTER (NOT d) AS undecided, count(*) FILTER (first IS NOT NULL AND second IS NOT NULL) AS "both", count(*) FILTER (first = second) AS same FROM y GROUP BY 1""")
def _(t):
    """Labels as the truth, two passes of tiers read off the lengths."""
    tier = lambda n: F.when(n % 5 == 1, "recommend").when(n % 5 == 2, "alternate").when(n % 5 == 3, "not_recommend").when(n % 5 == 4, "pending_check")
    truth = F.when(c("quality") == 1, "adopted").when(c("toxic") == 1, "dropped").otherwise("rejected")
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return measures.verdict_tally(rows.select(truth.alias("truth"), tier(F.floor(c("n_chars") / 7)).alias("first"), tier(F.floor(c("n_chars") / 10)).alias("second")))
