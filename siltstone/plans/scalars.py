"""Queries of filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import times as T
from siltstone.plans.registry import query

TS = "TIMESTAMP '2024-01-10 00:00:00'"


@query("o032_event_window", f"SELECT event_id, event_type FROM events WHERE coalesce(ts, {TS}) >= {TS} AND ts < TIMESTAMP '2024-01-12 12:00:00'")
def _(t):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-12 12:00:00"))
    return t.events.where(T.in_window(F.col("ts"), F.lit(None).cast("timestamp_ntz"), start, end)).select("event_id", "event_type")


@query("o033_arrival_window", f"SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderdate + INTERVAL 1 DAY) >= DATE '1998-01-01' AND coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderdate + INTERVAL 1 DAY) < DATE '1998-02-01'")
def _(t):
    first = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1998-01-01", "1998-02-01"))
    return t.orders.where(T.in_window(first, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), start, end)).select("o_orderkey")


_HOURS = "CASE WHEN dayofweek(ts + INTERVAL 8 HOUR) = 1 THEN 72 ELSE 24 END"
_MARK = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts + INTERVAL 2 HOUR WHEN 2 THEN ts - INTERVAL 300 HOUR ELSE ts - INTERVAL 30 HOUR END"


@query("o035_round_window", f"""
SELECT event_id, epoch_us(CASE WHEN m IS NULL OR m >= ts THEN ts - to_hours({_HOURS}) WHEN m < ts - INTERVAL 216 HOUR THEN ts - INTERVAL 216 HOUR ELSE m END) AS start_us,
  coalesce(m < ts AND m < ts - INTERVAL 216 HOUR, false) AS truncated FROM (SELECT *, {_MARK} AS m FROM events)""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    mark = F.timestamp_micros(F.when(F.col("event_id") % 4 == 1, us + 2 * 3_600_000_000).when(F.col("event_id") % 4 == 2, us - 300 * 3_600_000_000).when(F.col("event_id") % 4 == 3, us - 30 * 3_600_000_000))
    w = T.round_window(ts, mark)
    return t.events.select("event_id", F.unix_micros(w["start"]).alias("start_us"), w["truncated"].alias("truncated"))


@query("o036_task_window", f"""
SELECT event_id, epoch_us(CASE WHEN want < ts - INTERVAL 216 HOUR THEN ts - INTERVAL 216 HOUR ELSE want END) AS start_us, want < ts - INTERVAL 216 HOUR AS truncated
FROM (SELECT event_id, ts, least(ts - INTERVAL 40 HOUR, CASE WHEN m < ts THEN m END) AS want FROM (SELECT *, {_MARK} AS m FROM events))""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    mark = F.timestamp_micros(F.when(F.col("event_id") % 4 == 1, us + 2 * 3_600_000_000).when(F.col("event_id") % 4 == 2, us - 300 * 3_600_000_000).when(F.col("event_id") % 4 == 3, us - 30 * 3_600_000_000))
    w = T.task_window(ts, F.timestamp_micros(us - 40 * 3_600_000_000), mark)
    return t.events.select("event_id", F.unix_micros(w["start"]).alias("start_us"), w["truncated"].alias("truncated"))


@query("o034_image_only", "SELECT l_orderkey, bool_and(l_returnflag = 'N' OR l_linestatus = 'O') AND max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) = 1 AS image_only FROM lineitem GROUP BY l_orderkey")
def _(t):
    media = F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_linenumber")).alias("m")
    photo = F.forall("m", lambda x: (x["l_returnflag"] == "N") | (x["l_linestatus"] == "O"))
    return t.lineitem.groupBy("l_orderkey").agg(media).select("l_orderkey", (photo & F.exists("m", lambda x: x["l_linenumber"] == 1)).alias("image_only"))


@query("o038_dynamic_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1997-0%' ORDER BY o_orderkey DESC LIMIT 100")
def _(t):
    given = {"o_orderstatus": "F", "o_orderpriority": None}
    rows = t.orders
    for c, v in given.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows.where(F.date_format("o_orderdate", "yyyy-MM-dd").startswith("1997-0")).orderBy(F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_totalprice")


@query("o039_title_or_child", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND lower(p_brand) LIKE '%#17%')")
def _(t):
    child = t.lineitem.join(t.part.where(F.contains(F.lower("p_brand"), F.lit("#17"))), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    own = t.orders.where(F.contains(F.lower("o_orderpriority"), F.lit("urgent")))
    return own.select("o_orderkey").union(t.orders.join(child, "o_orderkey", "left_semi").select("o_orderkey")).distinct()


@query("o040_prefix", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'small')")
def _(t):
    return t.part.where(F.col("p_name").startswith("small")).select("p_partkey")


@query("o041_digits_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, '/[0-9]+')")
def _(t):
    return t.pages.where(F.col("url").rlike("/[0-9]+")).select("page_id")


_NORM = """lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''))"""


@query("o042_url_exclusion", f"SELECT page_id, {_NORM} AS norm FROM pages WHERE {_NORM} NOT IN (SELECT {_NORM} FROM pages JOIN labels ON doc_id = page_id WHERE toxic = 1)")
def _(t):
    pages = t.pages.select("page_id", X.norm_url(F.col("url")).alias("norm"))
    hidden = pages.join(t.labels.where("toxic = 1").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return pages.join(hidden.select("norm"), "norm", "left_anti").select("page_id", "norm")


@query("o043_violations", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END, CASE WHEN l_tax = 0 AND l_returnflag = 'R' THEN 'tax' END) AS violations FROM lineitem")
def _(t):
    c = F.col
    found = F.array_compact(F.array(F.when(c("l_quantity") > 45, "quantity"), F.when(c("l_discount") >= 0.1, "discount"), F.when((c("l_tax") == 0) & (c("l_returnflag") == "R"), "tax")))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(found, ",").alias("violations"))


@query("o044_parse_since", "SELECT event_id, coalesce(epoch_us(CASE event_id % 3 WHEN 0 THEN ts - to_days((event_id % 40)::INT) WHEN 1 THEN ts - to_hours((event_id % 40)::INT) END), -1) AS since_us FROM events")
def _(t):
    text = F.concat((F.col("event_id") % 40).cast("string"), F.element_at(F.array(F.lit("d"), F.lit("h"), F.lit("w")), (F.col("event_id") % 3 + 1).cast("int")))
    return t.events.select("event_id", F.coalesce(F.unix_micros(T.parse_since(text, F.col("ts").cast("timestamp"))), F.lit(-1)).alias("since_us"))


@query("o126_norm_url", f"SELECT page_id, {_NORM} AS norm FROM pages")
def _(t):
    return t.pages.select("page_id", X.norm_url(F.col("url")).alias("norm"))


@query("o127_brand_key", r"SELECT p_partkey, regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '', 'g') AS key FROM part")
def _(t):
    return t.part.select("p_partkey", X.brand_key(F.col("p_brand")).alias("key"))


@query("o128_candidate_key", "SELECT page_id, lower(regexp_replace(split_part(url, '/', 3), '[^A-Za-z0-9]', '', 'g')) || '-' || substr(sha256(url), 1, 6) AS key FROM pages")
def _(t):
    return t.pages.select("page_id", X.candidate_key(F.split_part("url", F.lit("/"), F.lit(3)), F.col("url"), F.col("page_id").cast("string")).alias("key"))


@query("o129_media_id", "SELECT doc_id, doc_id::VARCHAR AS id FROM documents")
def _(t):
    """Codes of eleven letters, six bits each, which hold any id."""
    n = F.col("doc_id").cast("bigint")
    letter = [F.substring(F.lit(X.CODE_ALPHABET), (F.shiftright(n, 6 * k).bitwiseAND(63) + 1).cast("int"), F.lit(1)) for k in range(10, -1, -1)]
    return t.documents.select("doc_id", X.media_id(F.concat(*letter)).alias("id"))


@query("o131_plain_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(X.plain_text(F.col("html"))).alias("text_md5"))


def _decode_sql(x: str) -> str:
    for name, char in X.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_TITLE = _decode_sql(r"regexp_replace(regexp_extract(html, '" + X.TITLE + r"', 1), '^\s+|\s+$', '', 'g')")
_PLAIN = _decode_sql("regexp_replace(regexp_replace(regexp_replace(html, '" + X.NO_TEXT + "', ' ', 'g'), '" + X.LINE_ENDS + "', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')")


@query("o130_html_to_text", rf"""
WITH p AS (SELECT page_id, {_TITLE} AS title, {_PLAIN} AS plain FROM pages),
b AS (SELECT page_id, title, substr(array_to_string(list_filter([trim(regexp_replace(v, '\s+', ' ', 'g')) FOR v IN string_split(plain, chr(10))], lambda v: v <> ''), chr(10)), 1, 20000) AS body FROM p)
SELECT page_id, md5(substr(CASE WHEN title = '' OR starts_with(body, title) THEN body ELSE title || chr(10) || body END, 1, 20000)) AS text_md5 FROM b""")
def _(t):
    return t.pages.select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("text_md5"))


@query("o132_urls_in", r"""SELECT page_id, array_to_string(list_distinct_ordered, ' ') AS urls FROM (SELECT page_id, list_slice(u, 1, 3) AS list_distinct_ordered FROM (
SELECT page_id, ['https://a.example/' || page_id, url] AS u FROM pages))""")
def _(t):
    text = F.concat(F.lit("see https://a.example/"), F.col("page_id").cast("string"), F.lit("），https://www.facebook.com/x and "), F.col("url"), F.lit(" or "), F.col("url"), F.lit("."))
    return t.pages.select("page_id", F.array_join(X.urls_in(text), " ").alias("urls"))


#: What texts begin with, dealt out by id, so that all scripts occur.
_SCRIPTS = ("", "これはペンです", "이것은 책", "这是一本书", "汉字" * 60)


def _scripted(t):
    """Whole documents behind a text in one of the scripts."""
    start = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("doc_id") % len(_SCRIPTS) + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(start, "text").alias("text"))


_SCRIPTED = f"x AS (SELECT doc_id, ({list(_SCRIPTS)})[doc_id % {len(_SCRIPTS)} + 1] || text AS text FROM documents)"


@query("o135_needs_translation", f"WITH {_SCRIPTED} SELECT doc_id, regexp_matches(text, '[぀-ヿㇰ-ㇿｦ-ﾝ]') OR len(regexp_extract_all(text, '[A-Za-z]')) >= 20 AND len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[㐀-䶿一-鿿]')) AS needs FROM x")
def _(t):
    return _scripted(t).select("doc_id", X.needs_translation(F.col("text")).alias("needs"))


@query("o136_language_bucket", f"WITH {_SCRIPTED} SELECT doc_id, CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS lang_bucket FROM x")
def _(t):
    return _scripted(t).select("doc_id", X.language_bucket(F.col("text")).alias("lang_bucket"))


@query("o137_heat_note", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS likes, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS comments, CASE WHEN o_orderkey % 4 = 1 THEN 900 END AS fans, CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 3 = 1 THEN 0 END AS base, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey / 7.0 END AS ratio, o_orderkey % 2 = 0 AS tagged FROM orders),
y AS (SELECT o_orderkey, concat_ws(' · ', likes || ' 赞' || CASE WHEN ratio IS NULL THEN '' WHEN base > 0 THEN ' · 常态 ' || base || ' 的 ' || printf('%.1f', ratio::DOUBLE) || '×' ELSE ' · 常态的 ' || printf('%.1f', ratio::DOUBLE) || '×' END, comments || ' 评论', '账号 ' || fans || ' 粉丝') AS parts, tagged FROM x)
SELECT o_orderkey, CASE WHEN tagged THEN parts || CASE WHEN parts = '' THEN '' ELSE '；' END || '标签：帐篷、new' WHEN parts = '' THEN '热度不详' ELSE parts END AS note FROM y""")
def _(t):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tags = F.when(k % 2 == 0, F.array(F.lit("帐篷"), F.lit(" "), F.lit("new")))
    base = F.when(k % 3 == 0, 7).when(k % 3 == 1, 0)
    note = X.heat_note(F.when(status == "F", F.col("o_custkey")), F.when(status != "P", k), F.when(k % 4 == 1, 900), base, F.when(k % 5 > 0, F.col("o_custkey") / 7.0), tags)
    return t.orders.select("o_orderkey", note.alias("note"))


@query("o138_number", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN value ELSE event_id * 1000.0 END::DOUBLE AS n FROM events")
def _(t):
    k = F.col("event_id") % 3
    text = F.when(k == 0, "--").when(k == 1, F.concat(F.col("value").cast("string"), F.lit("%"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(",000 s")))
    return t.events.select("event_id", X.number(text).alias("n"))


@query("o139_note_flags", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 10 AND l_tax = 0 THEN 'refresh_pending:观看>0 而曝光=0' END, CASE WHEN l_quantity > 10 AND l_discount = 0 THEN 'refresh_pending:观看>0 而平均时长=0' END) AS flags FROM lineitem")
def _(t):
    flags = X.note_flags(F.col("l_quantity") - 10, F.col("l_tax"), F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(flags, ",").alias("flags"))


@query("o140_derived_id", "SELECT doc_id, 'csv-' || substr(sha1(source || '|' || doc_id), 1, 10) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", F.concat(F.lit("csv-"), F.substring(F.sha1(F.concat_ws("|", "source", "doc_id")), 1, 10)).alias("id"))


@query("o141_sections", r"""SELECT doc_id, i - 1 AS line, regexp_extract(l, '^([^ ]+) (.+)$', 1) AS brand, regexp_extract(l, '^([^ ]+) (.+)$', 2) AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE regexp_matches(l, '^[^ ]+ .+$') AND length(l) <= 120 QUALIFY row_number() OVER (PARTITION BY doc_id, l ORDER BY i) = 1""")
def _(t):
    from siltstone.operators.records import keep_first

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).where(F.col("l").rlike("^[^ ]+ .+$") & (F.length("l") <= 120))
    rows = keep_first(lines, ["doc_id", "l"], ["line"])
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), *(F.regexp_extract("l", "^([^ ]+) (.+)$", k).alias(n) for k, n in ((1, "brand"), (2, "title"))))


@query("o145_fused_text", "SELECT doc_id, md5(substr(substr(source || chr(10) || text, 1, 1500), 1, 400)) AS cut_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.substring(F.substring(F.concat_ws("\n", "source", "text"), 1, 1500), 1, 400)).alias("cut_md5"))


@query("o146_fingerprint", "SELECT o_orderkey, sha256(o_orderstatus || chr(31) || o_custkey || chr(31) || array_to_string(list_sort(list(l_partkey::VARCHAR)), chr(31))) AS digest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey")
def _(t):
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderstatus", "o_custkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("refs"))
    return rows.select("o_orderkey", X.fingerprint([F.col("o_orderstatus"), F.col("o_custkey")], F.col("refs")).alias("digest"))


@query("o148_dedupe_text", r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '@\S+', '', 'g'), '\s+', '', 'g')) AS norm_md5 FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.md5(X.dedupe_text(F.col("text"))).alias("norm_md5"))


@query("o150_review_gaps", """SELECT event_id, gap, (n < 24) AND minutes >= gap AS due, n >= 3 AND hour(ts + INTERVAL 8 HOUR) >= 8 AND hour(ts + INTERVAL 8 HOUR) < 23 AS escalate
FROM (SELECT event_id, ts, event_id % 30 AS n, event_id % 70 AS minutes, CASE WHEN event_id % 30 < 2 THEN 15 WHEN event_id % 30 < 3 THEN 30 ELSE 60 END AS gap FROM events)""")
def _(t):
    now, n = F.col("ts").cast("timestamp"), F.col("event_id") % 30
    since = F.timestamp_micros(F.unix_micros(now) - F.col("event_id") % 70 * 60_000_000)
    due = T.remind_due(now, since, F.lit(None).cast("timestamp"), n)
    return t.events.select("event_id", T.review_gap(n).alias("gap"), due.alias("due"), T.escalate_due(now, n, F.lit(False)).alias("escalate"))


@query("o189_schedule", "SELECT event_id, CASE WHEN a <= b THEN m > a AND m <= b ELSE m > a OR m <= b END AS fires FROM (SELECT event_id, 480 AS m, event_id * 7 % 1440 AS a, (event_id * 7 + 30) % 1440 AS b FROM events)")
def _(t):
    a = F.col("event_id") * 7
    return t.events.select("event_id", T.schedule_fires(F.lit(480), a % 1440, (a + 30) % 1440).alias("fires"))
