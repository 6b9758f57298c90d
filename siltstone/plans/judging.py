"""Queries of intake and judgement: normalised records, clean-up rules, the rule cascade, history, sampled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import records, search, verdicts
from siltstone.plans.registry import query


@query("o005_partial_sweep", "SELECT source, count(*) AS n, true AS partial FROM (SELECT 'orders' AS source, o_orderkey FROM orders UNION ALL SELECT 'events', event_id FROM events) GROUP BY 1")
def _(t):
    rows = records.collect_sources([("orders", t.orders.select(F.col("o_orderkey").alias("k")), True), ("events", t.events.select(F.col("event_id").alias("k")), False), ("pages", None, False)])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.first("partial").alias("partial"))


@query("o012_merged_posts", """
WITH p AS (SELECT o_orderkey AS id, o_orderdate AS sent, o_orderstatus = 'P' AS deleted FROM orders WHERE o_orderpriority <> '1-URGENT'),
 m AS (SELECT o_orderkey AS id, o_orderdate AS sent, false AS deleted FROM orders WHERE o_orderpriority <> '5-LOW'),
 d AS (SELECT p_partkey AS id, TIMESTAMP '1998-01-01' AS sent FROM part)
SELECT id::VARCHAR AS post_id, 'published' AS state FROM p WHERE NOT deleted AND sent >= TIMESTAMP '1995-01-01'
UNION ALL SELECT id::VARCHAR, 'published' FROM m WHERE sent >= TIMESTAMP '1995-01-01' AND id NOT IN (SELECT id FROM p) UNION ALL SELECT 'draft:' || id, 'draft' FROM d""")
def _(t):
    posts = t.orders.select(F.col("o_orderkey").cast("string").alias("post_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "P").alias("deleted"))
    drafts = t.part.select(F.col("p_partkey").cast("string").alias("post_id"), F.col("p_name").alias("title"), F.lit("1998-01-01").cast("timestamp_ntz").alias("at"), F.lit(False).alias("deleted"))
    mass = posts.where("title <> '5-LOW'").withColumn("deleted", F.lit(False))
    return records.merge_posts(posts.where("title <> '1-URGENT'"), mass, drafts, F.lit("1995-01-01").cast("timestamp_ntz")).select("post_id", "state")


@query("o031_candidates", """
SELECT lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '-' || substr(sha256(o_orderkey::VARCHAR), 1, 6) AS candidate_key, coalesce(epoch_us(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END), -1) AS posted_us,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey ELSE -1 END AS likes, string_agg(CASE WHEN l_returnflag = 'N' THEN 'photo' ELSE 'video' END || (r - 1), ',' ORDER BY r) AS media, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS tags
FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS r FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name, o_custkey, o_orderdate, o_orderpriority""")
def _(t):
    k = F.col("o_orderkey")
    shot = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    media = F.transform(F.array_sort(F.collect_list(shot)), lambda m: F.struct(F.lit("h").alias("hash"), F.when(m["l_returnflag"] == "N", "PHOTO").otherwise("Reel").alias("type"), F.lit("u").alias("url")))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(media.alias("media")).join(t.orders, "o_orderkey").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    raw = rows.select(
        F.col("c_name").alias("account"), F.lit("").alias("url"), k.cast("string").alias("post_id"), F.lit("x").alias("description"), "media",
        F.when(k % 5 != 0, F.col("o_orderdate").cast("string")).otherwise("soon").alias("date_posted"), F.lit(None).cast("string").alias("ingested_at"),
        F.when(k % 7 != 0, F.col("o_custkey").cast("string")).otherwise("many").alias("likes"), F.lit("1").alias("comments"), F.lit("").alias("followers"),
        F.array(F.lit(""), F.when(k % 2 == 0, F.col("o_orderpriority"))).alias("tags"), F.array().cast("array<string>").alias("hashtags"))
    out = records.candidates(raw, "orders")
    names = F.array_join(F.transform("media", lambda m: F.concat(m["kind"], m["ordinal"].cast("string"))), ",")
    return out.select("candidate_key", F.coalesce(F.unix_micros("posted_at"), F.lit(-1)).alias("posted_us"), F.coalesce("likes", F.lit(-1)).alias("likes"), names.alias("media"), F.array_join("tags", ",").alias("tags"))


_CONTRAST = verdicts.CONTRAST


@query("o143_contrasts", rf"""
WITH x AS (SELECT doc_id, '这款从' || lang || '变成' || source || '。第二句！' || CASE doc_id % 3 WHEN 0 THEN '不再是旧款；' WHEN 1 THEN '告别' || lang || '，好。' ELSE '' END || '完' AS s, CASE WHEN doc_id % 4 = 0 THEN '原文：从' || lang || '变成这样' ELSE '' END AS src FROM documents),
 f AS (SELECT *, list_filter(list_distinct(regexp_extract_all(s, '{_CONTRAST}')), lambda p: NOT contains(src, p)) AS p FROM x),
 y AS (SELECT doc_id, s, p, regexp_extract_all(s, '[^。；！？\n]+[。；！？\n]?') AS v FROM f),
 z AS (SELECT doc_id, s, p, v, list_transform(v, lambda e: len(list_filter(p, lambda q: contains(e, q))) > 0) AS bad FROM y)
SELECT doc_id, array_to_string(list_sort(p), '|') AS phrases, array_to_string(list_transform(generate_series(1, len(v)), lambda i: CASE WHEN NOT bad[i] THEN v[i] WHEN i = list_position(bad, true) THEN '（无旧款依据的前后对比，已删）' ELSE '' END), '') AS clean FROM z""")
def _(t):
    k = F.col("doc_id") % 3
    end = F.when(k == 0, "不再是旧款；").when(k == 1, F.concat(F.lit("告别"), "lang", F.lit("，好。"))).otherwise("")
    text = F.concat(F.lit("这款从"), "lang", F.lit("变成"), "source", F.lit("。第二句！"), end, F.lit("完"))
    own = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("原文：从"), "lang", F.lit("变成这样"))).otherwise("")
    rows = t.documents.select("doc_id", text.alias("s"), own.alias("src"))
    rows = rows.withColumn("p", verdicts.contrast_phrases([F.col("s")], F.col("src")))
    return rows.select("doc_id", F.array_join(F.array_sort("p"), "|").alias("phrases"), verdicts.strip_sentences(F.col("s"), F.col("p")).alias("clean"))


def _pick(h, div: int, values: list):
    """One of the values by h // div; the same in SQL is _choose."""
    return F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (F.floor(h / div) % len(values) + 1).cast("int"))


def _choose(div: int, values: list[str]) -> str:
    return f"([{', '.join(values)}])[(h // {div}) % {len(values)} + 1]"


_TIERS = ["recommend", "alternate", "not_recommend", "pending_check"]
_WHY = ["none", "missing_material", "low_value", "angle_not_formed"]
_COMPARE = ["unrelated", "same_fact_no_gain", "unconfirmed", "new_angle"]
_GAPS = [[], [("decision", "只看了前3张", "collector", "")], [("decision", "无缺口", "editor", "x")], [("decision", "价格见官网", "collector", "")], [("boundary", "y", "collector", "")], [("minor", "z", "collector", "")]]
_GAP_SQL = ["[" + ", ".join(f"{{'l': '{a}', 'w': '{b}', 'o': '{c}', 'n': '{d}'}}" for a, b, c, d in g) + "]" for g in _GAPS]
_GAP_SQL[0] = "list_filter(" + _GAP_SQL[1] + ", lambda g: false)"
_LONG = "长" * 41


@query("o144_rule_cascade", rf"""
WITH r0 AS (SELECT doc_id, (doc_id * 7919 + 13) % 100003 AS h FROM documents),
r1 AS (SELECT doc_id, {_choose(1, [f"'{x}'" for x in _TIERS])} AS tier, {_choose(3, ['false', 'true', 'true'])} AS seen, {_choose(5, ['false', 'true'])} AS every, {_choose(7, ['true', 'false', 'false'])} AS deep,
 {_choose(11, ['true', 'false'])} AS may, {_choose(13, _GAP_SQL)} AS gaps, {_choose(17, [f"'{x}'" for x in _COMPARE])} AS cmp, {_choose(19, ["''", "'M1'", "'M2'", "'M9'"])} AS ref, {_choose(23, ['true', 'false'])} AS acme,
 {_choose(29, [f"'{x}'" for x in _WHY])} AS why, {_choose(31, ['true', 'false', 'true'])} AS gain, {_choose(37, ['true', 'true', 'false'])} AS csw, {_choose(41, ["'从木变成铁'", "''", "'好'"])} AS basis, {_choose(43, ["'M1'", "'M3'"])} AS mem,
 {_choose(47, ["''", "'椅子｜告别旧款'", f"'{_LONG}'", "'好椅子'"])} AS head, {_choose(53, ['true', 'false', 'false'])} AS evid, {_choose(59, ['true', 'false'])} AS complete, []::VARCHAR[] AS notes, []::VARCHAR[] AS again, '今天。不再是旧款。好' AS what FROM r0),
a1 AS (SELECT * REPLACE (CASE WHEN NOT every AND seen THEN 'pending_check' ELSE tier END AS tier, every AS seen, CASE WHEN NOT every AND seen THEN list_append(notes, 'pictures_unread') ELSE notes END AS notes) FROM r1),
a2 AS (SELECT *, len(list_filter(gaps, lambda g: g.w = '只看了前3张')) > 0 AND every AS said FROM a1),
a3 AS (SELECT * REPLACE (CASE WHEN said AND tier = 'pending_check' AND may THEN list_append(again, 'pictures') ELSE again END AS again, CASE WHEN said THEN list_append(notes, 'pictures_not_a_gap') ELSE notes END AS notes, CASE WHEN said THEN list_filter(gaps, lambda g: g.w <> '只看了前3张') ELSE gaps END AS gaps) FROM a2),
a4 AS (SELECT * REPLACE (CASE WHEN len(list_filter(gaps, lambda g: g.w = '无缺口')) > 0 THEN list_append(notes, 'no_gap_dropped') ELSE notes END AS notes, list_filter(gaps, lambda g: g.w <> '无缺口') AS gaps) FROM a3),
a5 AS (SELECT *, len(list_filter(gaps, lambda g: g.l = 'decision')) > 0 AS dec, NOT seen AND tier <> 'pending_check' AS un FROM a4),
a6 AS (SELECT * REPLACE (CASE WHEN un AND NOT dec THEN list_append(gaps, {{'l': 'decision', 'w': '未读到实图', 'o': 'collector', 'n': 'x'}}) ELSE gaps END AS gaps, CASE WHEN un THEN 'pending_check' ELSE tier END AS tier,
  list_concat(CASE WHEN un THEN list_append(notes, 'unseen_pending') ELSE notes END, CASE WHEN basis = '' THEN ['no_basis'] ELSE [] END) AS notes) FROM a5),
b1 AS (SELECT *, NOT evid AND may AS ask, NOT evid AND NOT may AS cut, ref = 'M1' AS hit1, cmp = 'same_fact_no_gain' AND ref <> 'M1' AS weak FROM a6),
b2 AS (SELECT * REPLACE (CASE WHEN ask THEN list_append(again, 'contrast') ELSE again END AS again, CASE WHEN cut THEN list_append(notes, 'contrast_removed') ELSE notes END AS notes, CASE WHEN cut AND head LIKE '%告别%' THEN '椅子' ELSE head END AS head,
  CASE WHEN cut THEN '今天。（无旧款依据的前后对比，已删）好' ELSE what END AS what) FROM b1),
b3 AS (SELECT * REPLACE (CASE WHEN weak THEN 'unconfirmed' ELSE cmp END AS cmp, list_concat(notes, CASE WHEN weak THEN ['same_fact_unproven'] ELSE [] END, CASE WHEN weak AND tier = 'not_recommend' AND NOT may THEN ['same_fact_pending'] ELSE [] END) AS notes,
  CASE WHEN weak AND tier = 'not_recommend' AND may THEN list_append(again, 'same_fact') ELSE again END AS again, CASE WHEN weak AND tier = 'not_recommend' AND NOT may THEN 'pending_check' ELSE tier END AS tier,
  CASE WHEN weak AND tier = 'not_recommend' AND NOT may THEN list_append(gaps, {{'l': 'decision', 'w': '查重未确认', 'o': 'editor', 'n': 'x'}}) ELSE gaps END AS gaps) FROM b2),
b4 AS (SELECT *, cmp = 'unrelated' AND tier IN ('recommend', 'alternate') AND (acme OR ref = 'M2') AS hist FROM b3),
b5 AS (SELECT * REPLACE (CASE WHEN hist THEN 'unconfirmed' ELSE cmp END AS cmp, CASE WHEN hist THEN list_append(notes, 'history_unread') ELSE notes END AS notes, CASE WHEN hist THEN list_append(gaps, {{'l': 'decision', 'w': '正文缺失', 'o': 'editor', 'n': 'x'}}) ELSE gaps END AS gaps) FROM b4),
c1 AS (SELECT * REPLACE (CASE WHEN tier = 'recommend' AND NOT gain THEN list_append(notes, 'gain_not_shown') WHEN tier = 'recommend' AND NOT csw THEN list_append(notes, 'fit_not_shown') ELSE notes END AS notes, CASE WHEN tier = 'recommend' AND NOT (gain AND csw) THEN 'alternate' ELSE tier END AS tier) FROM b5),
c2 AS (SELECT *, tier = 'not_recommend' AND (why = 'missing_material' OR why <> 'low_value' AND len(list_filter(gaps, lambda g: g.w = '价格见官网')) > 0) AS miss FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN miss THEN 'pending_check' ELSE tier END AS tier, CASE WHEN miss THEN list_append(notes, 'material_missing') ELSE notes END AS notes) FROM c2),
c4 AS (SELECT *, tier = 'pending_check' AND deep AS open_, len(list_filter(gaps, lambda g: g.l = 'decision')) > 0 AS dec2 FROM c3),
c5 AS (SELECT * REPLACE (list_concat(notes, CASE WHEN open_ THEN ['checked_still_open'] WHEN tier = 'pending_check' AND NOT dec2 THEN ['gap_supplied'] ELSE [] END) AS notes,
  list_concat(CASE WHEN open_ THEN list_transform(gaps, lambda g: CASE WHEN g.l = 'decision' THEN {{'l': g.l, 'w': g.w, 'o': 'editor', 'n': 'x'}} ELSE g END) ELSE gaps END, CASE WHEN tier = 'pending_check' AND NOT dec2 THEN [{{'l': 'decision', 'w': 'new', 'o': 'editor', 'n': 'x'}}] ELSE [] END) AS gaps) FROM c4),
c6 AS (SELECT * REPLACE (list_concat(notes, CASE WHEN len(list_filter(gaps, lambda g: g.o = 'collector' AND g.l <> 'boundary' AND g.n = '')) > 0 THEN ['next_supplied'] ELSE [] END, CASE WHEN mem = 'M1' THEN ['memory_refs_dropped'] ELSE [] END,
  CASE WHEN head = '' THEN ['headline_supplied'] WHEN length(head) > 40 THEN ['headline_long'] ELSE [] END) AS notes, CASE WHEN head = '' THEN what ELSE head END AS head) FROM c5),
d1 AS (SELECT *, len(list_filter(gaps, lambda g: g.l = 'decision' AND g.w = '查重未确认')) > 0 AS has, cmp = 'unconfirmed' AS dup FROM c6)
SELECT doc_id, CASE WHEN dup AND tier IN ('recommend', 'alternate') THEN 'pending_check' ELSE tier END AS tier, seen AS image_seen, complete AND NOT dup AS complete, head AS headline,
  array_to_string(list_concat(notes, CASE WHEN ref = 'M9' THEN ['bodies_as_given'] ELSE [] END, CASE WHEN dup AND tier <> 'not_recommend' AND NOT has THEN ['duplicate_gap'] ELSE [] END, CASE WHEN dup AND tier IN ('recommend', 'alternate') THEN ['duplicate_pending'] ELSE [] END, CASE WHEN dup AND complete THEN ['not_complete'] ELSE [] END), ',') AS notes,
  array_to_string(again, ',') AS again, len(gaps) + CASE WHEN dup AND tier <> 'not_recommend' AND NOT has THEN 1 ELSE 0 END AS n_gaps FROM d1""")
def _(t):
    h = (F.col("doc_id") * 7919 + 13) % 100003
    truth = lambda *v: [F.lit(x) for x in v]
    gap = lambda g: F.struct(*(F.lit(v).alias(n) for n, v in zip(("level", "what", "owner", "tried", "next"), (*g[:3], "", g[3]))))
    gaps = [F.array(*(gap(g) for g in some)).cast(f"array<{verdicts.GAP}>") for some in _GAPS]
    names = ("no", "kind", "brand", "title", "source", "state", "body", "excerpt")
    given = [("M1", "published", "Acme", "t1", "https://x", "published", True, "e"), ("M2", "prior_ledger", "Other", "t2", "javascript:1", "", False, ""), ("M3", "memory", "", "t3", "", "", False, ""), ("M4", "example", "Acme!", "t4", "", "", False, "")]
    materials = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, m))) for m in given))
    dims = F.array(*(F.struct(F.lit(d).alias("dim"), v.alias("verdict"), b.alias("basis")) for d, v, b in (
        ("gain", F.when(_pick(h, 31, truth(True, False, True)), "yes").otherwise("no"), F.lit("b")),
        ("csw", F.when(_pick(h, 37, truth(True, True, False)), "yes").otherwise("no"), F.lit("b")),
        ("change", F.lit("yes"), _pick(h, 41, ["从木变成铁", "", "好"])))))
    ref = _pick(h, 19, ["", "M1", "M2", "M9"])
    hit = F.array(F.struct(ref.alias("ref"), F.lit("t").alias("title"), F.lit("javascript:2").alias("url"), F.lit("published").alias("state"), F.lit(True).alias("body")))
    fields = {
        "tier": _pick(h, 1, _TIERS), "image_seen": _pick(h, 3, truth(False, True, True)), "images_all_read": _pick(h, 5, truth(False, True)), "deepchecked": _pick(h, 7, truth(True, False, False)),
        "may_ask_again": _pick(h, 11, truth(True, False)), "gaps": _pick(h, 13, gaps), "comparison": _pick(h, 17, _COMPARE), "hits": F.filter(hit, lambda x: x["ref"] != ""), "materials": materials,
        "brand_keys": F.array(_pick(h, 23, ["acme", "else"])), "unanswered": _pick(h, 29, _WHY), "dims": dims, "memory_refs": F.array(_pick(h, 43, ["M1", "M3"])), "headline": _pick(h, 47, ["", "椅子｜告别旧款", _LONG, "好椅子"]),
        "novelty_kind": F.when(_pick(h, 53, truth(True, False, False)), "evidenced_change").otherwise("new"), "prior_evidence": F.lit("x"), "complete": _pick(h, 59, truth(True, False)), "what": F.lit("今天。不再是旧款。好"),
    }
    rows = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("candidate_key"), *(c.alias(n) for n, c in fields.items()), *(F.lit(None).cast(verdicts.FIELDS[n]).alias(n) for n in verdicts.FIELDS if n not in fields))
    out = verdicts.apply_rules(rows)
    return out.select("doc_id", "tier", "image_seen", "complete", "headline", F.array_join("notes", ",").alias("notes"), F.array_join("again", ",").alias("again"), F.size("gaps").alias("n_gaps"))


_CLAIM = "CASE doc_id % 4 WHEN 0 THEN '五类材料均已提供。' WHEN 1 THEN '查过，五类对照齐备记录或查询结果' WHEN 2 THEN '前文；这几条的事实级查重只能是未确认' ELSE '' END"


@query("o143_claims_of_material", f"""WITH x AS (SELECT doc_id, {_CLAIM} AS n, CASE doc_id % 3 WHEN 0 THEN 'unconfirmed' ELSE 'new_angle' END AS cmp, doc_id % 5 = 0 AS given, doc_id % 2 = 0 AS ready FROM documents),
a AS (SELECT * REPLACE (CASE WHEN cmp <> 'unconfirmed' THEN replace(n, '{verdicts.TEXTS["only_unconfirmed"]}', '{verdicts.TEXTS["not_counted"]}') ELSE n END AS n) FROM x),
b AS (SELECT *, NOT given AND regexp_matches(n, '{verdicts.ALL_PROVIDED}') AS claim, regexp_replace(n, '{verdicts.ALL_PROVIDED}', '{verdicts.TEXTS["all_looked_up"]}', 'g') AS m FROM a)
SELECT doc_id, CASE WHEN claim THEN m || CASE WHEN m LIKE '%。' THEN '' ELSE '；' END || '正文未得：M2（只有标题或决定摘要），' || CASE cmp WHEN 'unconfirmed' THEN '{verdicts.TEXTS["only_unconfirmed"]}' ELSE '{verdicts.TEXTS["not_counted"]}' END || '。' ELSE n END AS comparison_note,
 CASE WHEN cmp = 'unconfirmed' AND ready THEN '甲；{verdicts.TEXTS["not_complete"]}' ELSE '甲' END AS readiness_note,
 CASE WHEN cmp = 'unconfirmed' THEN CASE WHEN given THEN '{verdicts.TEXTS["undecided"]}' ELSE '查重未确认：M2《t》正文不可得，核不了是否同一事实' END END AS asked FROM b""")
def _(t):
    """Notes that claim all material while a hit's text wasn't given, and what is asked of the editor then."""
    k = F.col("doc_id")
    note = F.when(k % 4 == 0, "五类材料均已提供。").when(k % 4 == 1, "查过，五类对照齐备记录或查询结果").when(k % 4 == 2, "前文；这几条的事实级查重只能是未确认").otherwise("")
    given = k % 5 == 0
    names = ("no", "kind", "brand", "title", "source", "state", "body", "excerpt")
    material = F.array(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, ("M2", "published", "", "t", "https://x", "published"))), given.alias("body"), F.lit("e").alias("excerpt")))
    hit = F.array(F.struct(F.lit("M2").alias("ref"), F.lit("t").alias("title"), F.lit("").alias("url"), F.lit("published").alias("state"), F.lit(True).alias("body")))
    fields = {"comparison_note": note, "readiness_note": F.lit("甲"), "complete": k % 2 == 0, "comparison": F.when(k % 3 == 0, "unconfirmed").otherwise("new_angle"), "hits": hit, "materials": material, "tier": F.lit("alternate"), "image_seen": F.lit(True), "images_all_read": F.lit(True)}
    rows = t.documents.select("doc_id", k.cast("string").alias("candidate_key"), *(v.alias(n) for n, v in fields.items()), *(F.lit(None).cast(verdicts.FIELDS[n]).alias(n) for n in verdicts.FIELDS if n not in fields))
    out = verdicts.apply_rules(rows)
    asked = F.filter("gaps", lambda g: g["what"].startswith("查重"))
    return out.select("doc_id", "comparison_note", "readiness_note", F.get(asked, F.lit(0))["what"].alias("asked"))


@query("o149_fences_and_suffixes", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '· 【' || source || '】' WHEN 1 THEN '·   Candidate_Key ： ' || lang WHEN 2 THEN '· [' || lang || '] x' WHEN 3 THEN '---' ELSE 'see 【x】' END || chr(10) || 'end' AS fenced,
 'https://x/' || source || CASE WHEN doc_id % 2 = 0 THEN '?a=1&' ELSE '?' END || 'x-oss-process=image/resize,w_400/format,jpg/quality,q_80' AS url, CASE doc_id % 3 WHEN 2 THEN 'A | ' || source || ' is too long a tail' ELSE 'A | b' END AS title FROM documents""")
def _(t):
    k = F.col("doc_id")
    line = F.when(k % 5 == 0, F.concat(F.lit("【"), "source", F.lit("】"))).when(k % 5 == 1, F.concat(F.lit("  Candidate_Key ： "), "lang")).when(k % 5 == 2, F.concat(F.lit("["), "lang", F.lit("] x"))).when(k % 5 == 3, "─━═").otherwise("see 【x】")
    url = F.concat(F.lit("https://x/"), "source", F.when(k % 2 == 0, "?a=1").otherwise(""))
    title = F.when(k % 3 == 2, F.concat(F.lit("A | "), "source", F.lit(" is too long a tail"))).otherwise(F.concat(F.lit("A | b | "), F.when(k % 3 == 0, "《a long name of a column》").otherwise("short")))
    return t.documents.select("doc_id", X.fence(F.concat(line, F.lit("\r\nend"))).alias("fenced"), X.sized_url(url, 400).alias("url"), X.strip_title_suffix(title).alias("title"))


@query("o186_history_hits", r"""
WITH u AS (SELECT r_regionkey AS "user", lower(r_name) AS w, 0 AS turn FROM region UNION ALL SELECT r_regionkey, lower(regexp_replace(r_name, '[^A-Za-z0-9]', '', 'g')), 1 FROM region UNION ALL SELECT r_regionkey, 'small', 2 FROM region),
 d AS (SELECT p_partkey AS key, p_type AS kind, p_name || ' ' || r_name AS title, p_brand AS brand, p_size::VARCHAR AS published, p_brand AS url FROM part JOIN region ON r_regionkey = p_partkey % 4),
 h AS (SELECT w, d.*, row_number() OVER (PARTITION BY w ORDER BY published DESC, key) AS rank FROM (SELECT DISTINCT w FROM u WHERE length(w) >= 3) JOIN d ON contains(lower(title || chr(10) || brand || chr(10) || url), w) QUALIFY rank <= 5),
 o AS (SELECT "user", kind, title, published, url, turn, rank FROM h JOIN u USING (w) QUALIFY row_number() OVER (PARTITION BY "user", kind, title ORDER BY turn, rank) = 1)
SELECT "user", kind, title, published, url, row_number() OVER (PARTITION BY "user" ORDER BY turn, rank) AS place FROM o QUALIFY place <= 5""")
def _(t):
    users = t.region.select(F.col("r_regionkey").alias("user"), F.concat(F.lit("_"), "r_name", F.lit("__")).alias("username"), F.lit("Small").alias("full_name"))
    docs = t.part.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("p_partkey") % 4)
    docs = docs.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", "r_name").alias("title"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("body"), F.col("p_size").cast("string").alias("published"), F.col("p_brand").alias("url"))
    return search.history_hits(users, docs)


@query("o190_pair_sample", """
WITH b AS (SELECT l.*, sha256(k::VARCHAR) AS h, ('0x' || substr(sha256(k::VARCHAR), 1, 8))::BIGINT % 64 AS s FROM (SELECT doc_id AS k, lang AS a, source AS b FROM documents) l),
 p AS (SELECT 'same_account' AS bucket, k, lead(k) OVER (PARTITION BY b, a, s ORDER BY h, k) AS n FROM b
  UNION ALL SELECT * FROM (SELECT 'cross_account', k, CASE WHEN lead(a) OVER w <> a THEN lead(k) OVER w END FROM b WINDOW w AS (PARTITION BY b, s ORDER BY h, k))
  UNION ALL SELECT * FROM (SELECT 'unrelated', k, CASE WHEN lead(b) OVER w <> b THEN lead(k) OVER w END FROM b WINDOW w AS (PARTITION BY s ORDER BY h, k)))
SELECT bucket, least(k, n) AS i, greatest(k, n) AS j FROM p WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY sha256(least(k, n) || '-' || greatest(k, n)), least(k, n), greatest(k, n)) <= 50""")
def _(t):
    return records.sample_pairs(t.documents, "doc_id", "lang", "source", 50)
