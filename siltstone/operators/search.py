"""Retrieval: postings, phrase hits with BM25, exact vector neighbours, fusion and merging of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators.automata import contains_alias
from siltstone.operators.joins import join_checked
from siltstone.operators.neighbours import nearest, similar_pairs  # noqa: F401
from siltstone.operators.ordered import in_order
from siltstone.operators.records import top_per_key
from siltstone.session import materialize

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term and how often the document has it; long documents are exploded where they lie."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def common_terms(docs: DataFrame, text: str, share: int = 20, least: int = 16) -> DataFrame:
    """term and df, how many documents have it, of those that more than a share and a least number of documents have.

    A document's distinct terms are found where it lies, so that terms are shuffled once, after they were counted there.
    """
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where(F.col("df") > max(docs.count() // share, least))


def bm25_hits(docs: DataFrame, key: str, text: str, terms: DataFrame, per_term: int = 4, common_share: int = 20, common_least: int = 16, only: Column | None = None) -> DataFrame:
    """The best documents of each term: term, key, score, rank. terms is a written table with a column term.

    only, a condition on docs, restricts the hits to some kinds of documents; scores stay those among all documents.

    Terms that more than a share of the documents, and more than a least number, have are left out. Only the postings
    of the terms are shuffled, after the terms were sent to all executors or, if they are many, joined.
    """
    words = docs.select(key, (F.lit(True) if only is None else F.coalesce(only, F.lit(False))).alias("_of_kind"), tokens(F.col(text)).alias("_words")).withColumn("length", F.size("_words"))
    total = words.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    own = words.select(key, "_of_kind", "length", F.explode("_words").alias("term"))
    own = join_checked(own, terms.select("term").distinct(), ["term"], "left_semi", 80)
    hits = materialize(own.groupBy(key, "_of_kind", "term", "length").agg(F.count("*").alias("tf")), "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(total))  # one row
    scored = scored.where("_of_kind").where(F.col("df") <= F.greatest(F.floor(F.col("total") / common_share), F.lit(common_least)))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
    scored = scored.withColumn("score", F.round(idf * F.col("tf") * (K1 + 1) / norm, 6))
    return top_per_key(scored, ["term"], [F.desc("score"), key], per_term).select("term", key, "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def reciprocal_ranks(routes: list[DataFrame], group: list[str], key: str, limit: int, base: int = 60) -> DataFrame:
    """Fuse ranked lists: the sum of 1 / (base + rank) over the routes, ties by key."""
    every = routes[0].select(*group, key, "rank")
    for r in routes[1:]:
        every = every.unionByName(r.select(*group, key, "rank"))
    fused = every.groupBy(*group, key).agg(F.round(F.sum(1.0 / (base + F.col("rank"))), 9).alias("score"))
    return top_per_key(fused, group, [F.desc("score"), key], limit)


def merge_routes(routes: list[DataFrame], group: list[str], key: str) -> DataFrame:
    """Documents of several routes first, by number of routes and best rank; then those of one route in turns."""
    every = None
    for n, r in enumerate(routes):
        own = r.select(*group, key, F.col("rank"), F.lit(n).alias("route"))
        every = own if every is None else every.unionByName(own)
    merged = every.groupBy(*group, key).agg(F.count("*").alias("routes"), F.min("rank").alias("best"), F.min("route").alias("route"))
    single = F.col("routes") == 1
    lanes = merged.withColumn("_lane", F.when(single, F.col("route")).otherwise(-1))
    turns = in_order(lanes, [*group, "_lane"], [F.col("best").asc(), F.col(key).asc()]).withColumn("_turn", F.when(single, F.col("rank")))
    order = [F.when(single, 1).otherwise(0), F.when(~single, -F.col("routes")), F.when(~single, F.col("best")), F.col("_turn"), F.when(single, F.col("route")), F.col(key)]
    placed = in_order(turns.select(*group, key, "routes", "best", "route", "_turn"), group, [x.asc() for x in order])
    return placed.select(*group, key, "routes", (F.col("rank") + 1).alias("place"))


def history_hits(users: DataFrame, docs: DataFrame, per_word: int = 5, most: int = 5) -> DataFrame:
    """user, kind, title, published, url and place: earlier documents that name a user (user, username, full_name).

    Looked for are the username, its letters and digits if they are four or more, and the full name of three or more
    characters, whatever their case, in title, brand, body and url of docs (key, kind, title, brand, body, url,
    published). The newest per_word of each word count, one of each kind and title; then the first `most` in the order
    of the words.
    """
    name = F.replace(F.regexp_replace("username", "^_+|_+$", ""), F.lit("__"), F.lit("_"))
    core = F.regexp_replace("username", "[^A-Za-z0-9]", "")
    words = F.array(name, F.when(F.length(core) >= 4, core), F.when(F.length("full_name") >= 3, F.col("full_name")))
    asked = users.select("user", F.posexplode(words).alias("turn", "word")).where(F.octet_length("word") >= 3)
    texts = docs.select("key", F.concat_ws("\n", "title", "brand", "body", "url").alias("_text"))
    asked = asked.withColumn("word", F.lower("word"))
    hits = contains_alias(texts, "key", "_text", asked.select(F.col("word").alias("brand"), F.col("word").alias("alias")))
    newest = [F.desc(F.coalesce("published", F.lit(""))), "key"]
    rows = hits.select("key", F.col("brand").alias("word")).join(docs.drop("brand", "body"), "key")
    top = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("word").orderBy(*newest))).where(F.col("_rank") <= per_word)
    mine = top.join(asked, "word")
    order = ["turn", "_rank"]
    once = mine.withColumn("_copy", F.row_number().over(Window.partitionBy("user", "kind", "title").orderBy(*order))).where("_copy = 1")
    place = F.row_number().over(Window.partitionBy("user").orderBy(*order))
    return once.withColumn("place", place).where(F.col("place") <= most).select("user", "kind", "title", "published", "url", "place")
