"""Queries of retrieval, aliases and text candidates beyond those of the relational module."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import ordered, records, search
from siltstone.plans.registry import query

c = F.col

_COS = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_KNN = f"SELECT q.vec_id AS query_id, v.vec_id, v.label = q.label AS same, {_COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id"


def _queries(t):
    return t.embeddings.where("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), "embedding")


@query("o037_filtered_knn", f"SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, similarity FROM ({_KNN})) JOIN documents ON doc_id = vec_id WHERE lang IN ('en', 'de') AND n_chars >= 200 QUALIFY rank <= 8")
def _(t):
    """The filter comes before the scores."""
    fit = t.documents.where("lang IN ('en', 'de') AND n_chars >= 200").select(c("doc_id").alias("vec_id"))
    return search.nearest(_queries(t), t.embeddings.join(fit, "vec_id", "left_semi"), 8)


@query("o073_first_hit", f"SELECT query_id, coalesce(min(CASE WHEN same THEN rank END), -1) AS first_hit, count(*) FILTER (WHERE same) AS hits FROM ({_KNN} QUALIFY rank <= 24) GROUP BY 1")
def _(t):
    label = t.embeddings.select("vec_id", "label")
    near = search.nearest(_queries(t), t.embeddings, 24).join(label, "vec_id")
    near = near.join(label.select(c("vec_id").alias("query_id"), c("label").alias("own")), "query_id")
    same = c("label") == c("own")
    return near.groupBy("query_id").agg(F.coalesce(F.min(F.when(same, c("rank"))), F.lit(-1)).alias("first_hit"), F.count_if(same).alias("hits"))


@query("o089_longest_words", r"SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS rank FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM benchmark) QUALIFY rank <= 8")
def _(t):
    words = t.benchmark.select("item_id", F.posexplode(X.tokens(c("text"))).alias("i", "w"))
    return records.top_per_key(words, ["item_id"], [F.length("w").desc(), "i"], 8).select("item_id", "w", "rank")


_ALIAS = "(SELECT DISTINCT p_brand AS brand, unnest(string_split(lower(p_name), ' ')) AS alias FROM part)"


def _aliases(t):
    return t.part.select(c("p_brand").alias("brand"), F.explode(F.split(F.lower("p_name"), " ")).alias("alias")).distinct()


@query("o099_alias_match", f"SELECT doc_id, brand, max(struct_pack(n := length(alias), a := alias)).a AS alias FROM documents JOIN {_ALIAS} ON length(alias) >= 4 AND contains(lower(text), alias) GROUP BY ALL")
def _(t):
    return search.contains_alias(t.documents, "doc_id", "text", _aliases(t).where(X.alias_tells(c("alias"))))


@query("o179_dominant_brand", f"SELECT doc_id, min(struct_pack(n := -length(alias), b := brand)).b AS brand FROM documents JOIN {_ALIAS} ON length(alias) >= 4 AND contains(lower(text), alias) GROUP BY 1")
def _(t):
    hits = search.contains_alias(t.documents, "doc_id", "text", _aliases(t).where(X.alias_tells(c("alias"))))
    return hits.groupBy("doc_id").agg(F.min_by("brand", F.struct(-F.length("alias"), "brand")).alias("brand"))


@query("o100_brand_route", r"SELECT regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '', 'g') AS key, p_partkey, row_number() OVER (PARTITION BY key ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 8")
def _(t):
    rows = t.part.withColumn("key", X.brand_key(c("p_brand")))
    return records.top_per_key(rows, ["key"], [F.desc("p_size"), "p_partkey"], 8).select("key", "p_partkey", "rank")


@query("o112_brand_pages", r"SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 20")
def _(t):
    rows = t.orders.join(t.customer.select(c("c_custkey").alias("o_custkey"), X.brand_key(c("c_mktsegment")).alias("k"), "c_mktsegment"), "o_custkey")
    when = F.when(c("o_orderstatus") != "P", c("o_orderdate")).desc_nulls_last()
    return records.top_per_key(rows, ["k"], [when, "o_orderkey"], 20).select("c_mktsegment", "o_orderkey", "rank")


@query("o101_tokens", r"SELECT doc_id, len(ws) AS n, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)")
def _(t):
    ws = X.tokens(c("text"))
    return t.documents.select("doc_id", F.size(ws).alias("n"), F.md5(F.array_join(ws, " ")).alias("tokens_md5"))


@query("o107_cut_then_hide", "SELECT source, doc_id FROM (SELECT source, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10) LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0")
def _(t):
    """The cut comes first, so that hidden rows leave gaps."""
    top = records.top_per_key(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 10)
    return top.join(t.labels.where("toxic <> 0").select("doc_id"), "doc_id", "left_anti").select("source", "doc_id")


@query("o108_rerank", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY quality * 10 + toxic DESC NULLS LAST, vec_id) AS place FROM embeddings LEFT JOIN labels ON doc_id = vec_id")
def _(t):
    scores = t.labels.select(c("doc_id").alias("vec_id"), (c("quality") * 10 + c("toxic")).alias("score"))
    rows = t.embeddings.select("vec_id", "label").join(scores, "vec_id", "left")
    return ordered.in_order(rows, ["label"], [c("score").desc_nulls_last(), c("vec_id").asc()]).select("vec_id", (c("rank") + 1).alias("place"))


@query("o109_kind_completion", """WITH k AS (SELECT n_nationkey AS nation, kind FROM nation, (SELECT DISTINCT c_mktsegment AS kind FROM customer)), p AS (SELECT c_nationkey AS nation, c_mktsegment AS kind, max(struct_pack(b := c_acctbal, k := -c_custkey)).k * -1 AS best FROM customer WHERE c_acctbal > 8000 GROUP BY ALL),
n AS (SELECT c_mktsegment AS kind, max(c_custkey) AS newest FROM customer GROUP BY 1) SELECT nation, kind, coalesce(best, newest) AS c_custkey, CASE WHEN best IS NULL THEN 'newest' ELSE 'pool' END AS origin FROM k LEFT JOIN p USING (nation, kind) LEFT JOIN n USING (kind)""")
def _(t):
    """Each kind gets the best of the pool or else the newest of all; kinds are few and come as one array."""
    kinds = t.customer.agg(F.collect_set("c_mktsegment").alias("kinds"))
    need = t.nation.crossJoin(F.broadcast(kinds)).select(c("n_nationkey").alias("nation"), F.explode("kinds").alias("kind"))  # one row
    rows = t.customer.select(c("c_nationkey").alias("nation"), c("c_mktsegment").alias("kind"), "c_custkey", "c_acctbal")
    best = rows.where("c_acctbal > 8000").groupBy("nation", "kind").agg(F.max_by("c_custkey", F.struct("c_acctbal", -c("c_custkey"))).alias("best"))
    newest = rows.groupBy("kind").agg(F.max("c_custkey").alias("newest"))
    out = need.join(best, ["nation", "kind"], "left").join(newest, "kind", "left")
    return out.select("nation", "kind", F.coalesce("best", "newest").alias("c_custkey"), F.when(c("best").isNull(), "newest").otherwise("pool").alias("origin"))


@query("o111_owners_of_hits", """WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS hit FROM part QUALIFY hit <= 20)
SELECT DISTINCT hit, o_orderkey FROM h JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey QUALIFY row_number() OVER (PARTITION BY hit ORDER BY o_orderdate DESC, o_orderkey, l_linenumber) <= 10""")
def _(t):
    top = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).agg(F.array_sort(F.collect_list(F.struct((-c("p_retailprice")).alias("p"), "p_partkey"))).alias("x"))
    hits = top.select(F.posexplode("x").alias("i", "v")).select((c("i") + 1).alias("hit"), c("v.p_partkey").alias("l_partkey"))
    rows = t.lineitem.join(F.broadcast(hits), "l_partkey").join(t.orders, c("o_orderkey") == c("l_orderkey"))  # twenty rows
    return records.top_per_key(rows, ["hit"], [F.desc("o_orderdate"), "o_orderkey", "l_linenumber"], 10).select("hit", "o_orderkey").distinct()


@query("o113_embedding_worklist", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY text")
def _(t):
    todo = t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(t.embeddings.select(c("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return todo.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("o115_materials", r"""SELECT source, 'M' || row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS number, doc_id, md5(substr(trim(regexp_replace(regexp_replace(text, '<[^>]*(>|$)', ' ', 'g'), '\s+', ' ', 'g')), 1, 400)) AS excerpt_md5
FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 3)""")
def _(t):
    """Ranks come without the texts, which are joined to the few rows that stay."""
    top = records.top_per_key(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"], 3)
    number = F.row_number().over(Window.partitionBy("source").orderBy("lang", "doc_id"))
    numbered = top.select("source", F.concat(F.lit("M"), number.cast("string")).alias("number"), "doc_id")
    return numbered.join(t.documents.select("doc_id", "text"), "doc_id").select("source", "number", "doc_id", F.md5(F.substring(X.plain_text(c("text")), 1, 400)).alias("excerpt_md5"))


@query("o125_content_identity", "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


@query("o133_date_candidates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%b %-d, %Y') || '|' || strftime(o_orderdate, '%-d/%-m') AS dates, '$' || floor(o_totalprice)::BIGINT || '|' || (o_custkey + 10) || ' USD' AS prices FROM orders")
def _(t):
    d = {k: F.date_format("o_orderdate", k) for k in ("yyyy-MM-dd", "MMM d, yyyy", "d/M")}
    text = F.concat(F.lit("on "), d["yyyy-MM-dd"], F.lit(" or "), d["MMM d, yyyy"], F.lit("; "), F.upper(d["MMM d, yyyy"]), F.lit("; "), d["d/M"])
    cost = F.concat(F.lit("for $"), F.floor("o_totalprice").cast("string"), F.lit(" and "), (c("o_custkey") + 10).cast("string"), F.lit(" USD"))
    return t.orders.select("o_orderkey", F.array_join(X.date_candidates(text), "|").alias("dates"), F.array_join(X.price_candidates(cost), "|").alias("prices"))


@query("o134_product_candidates", "SELECT p_partkey, p_brand || ' ' || p_name || '|' || p_brand || ' ' || lower(p_type) AS products FROM part")
def _(t):
    text = F.concat("p_brand", F.lit(": "), "p_name", F.lit(". "), F.lower("p_brand"), F.lit(" - "), F.lower("p_type"), F.lit("! "), "p_brand", F.lit(" "), F.upper("p_name"))
    return t.part.select("p_partkey", F.array_join(X.product_candidates(text, c("p_brand")), "|").alias("products"))


@query("o184_designated", r"SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS code FROM pages WHERE code <> '' AND code::BIGINT NOT IN (SELECT doc_id FROM labels)")
def _(t):
    codes = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "url", "url"), F.lit("^[^ ]*?/([0-9]+)"), F.lit(1)))
    found = t.pages.select("page_id", F.explode(codes).alias("code"))
    return found.join(t.labels.select(c("doc_id").cast("string").alias("code")), "code", "left_anti").select("page_id", "code")


@query("o191_sections", r"SELECT doc_id, i AS block, sum(CASE WHEN length(l) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS section FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def _(t):
    """A short line opens a section; only positions and marks are shuffled, not the text."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).select("doc_id", (c("i") + 1).alias("block"), (F.length("l") < 40).cast("int").alias("head"))
    return lines.select("doc_id", "block", F.sum("head").over(Window.partitionBy("doc_id").orderBy("block")).alias("section"))
