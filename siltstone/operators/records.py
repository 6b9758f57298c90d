"""Operators on record tables: first and latest rows, upserts, reconciliation, fallback joins, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import candidate_key
from siltstone.session import materialize


def _columns(names: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def keep_first(df: DataFrame, key: list, order: list, exempt: Column | None = None) -> DataFrame:
    """The first row of each key; rows for which exempt is true all stay. order ends in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*_columns(key)).orderBy(*_columns(order)))
    keep = F.col("_rank") == 1
    if exempt is not None:
        keep = keep | exempt
    return df.withColumn("_rank", rank).where(keep).drop("_rank")


def top_per_key(df: DataFrame, key: list, order: list, n: int) -> DataFrame:
    """The first n rows of each key with their rank from 1; Spark cuts groups before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*_columns(key)).orderBy(*_columns(order)))).where(F.col("rank") <= n)


def latest(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """The row of each key with the largest `by`, as an aggregate, so that keys with many rows are combined early."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_row")).select(*key, *(f"_row.{c}" for c in rest))


def upsert(old: DataFrame, new: DataFrame, key: list[str], policy: dict[str, str]) -> DataFrame:
    """old with new rows put in. policy for each other column: overwrite, keep (old if new is empty), fill (new if not null) or first (old if not null)."""
    a, b = old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    for c in policy:
        a, b = a.withColumnRenamed(c, f"_a_{c}"), b.withColumnRenamed(c, f"_b_{c}")
    rules = {
        "overwrite": lambda c: F.when(F.col("_new"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")),
        "keep": lambda c: F.when(F.coalesce(F.col(f"_b_{c}").cast("string"), F.lit("")) == "", F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")),
        "fill": lambda c: F.coalesce(F.col(f"_b_{c}"), F.col(f"_a_{c}")),
        "first": lambda c: F.coalesce(F.col(f"_a_{c}"), F.col(f"_b_{c}")),
    }
    return a.join(b, key, "full").select(*key, *(rules[p](c).alias(c) for c, p in policy.items()))


def changes(old: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """key and change: inserted, changed, same or missing, by a hash of the content columns."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256).alias(name))

    both = digest(old, "_a").join(digest(new, "_b"), key, "full")
    change = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "missing").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return both.select(*key, change.alias("change"))


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key it doesn't have; of new rows with one key any may come in."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def guarded_status(old: Column, new: Column, locked: list[str]) -> Column:
    """A locked status isn't set back by an upstream."""
    return F.when(old.isin(locked), old).otherwise(new)


def fallback_join(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], loose_value: dict[str, str], values: list[str]) -> DataFrame:
    """left with values of right by the exact key, else by the loose key with fixed other columns; right's rest is added."""
    hit = right.select(*exact, *(F.col(v).alias(f"_x_{v}") for v in values), F.lit(True).alias("_x"))
    channel = right
    for c, v in loose_value.items():
        channel = channel.where(F.col(c) == v)
    channel = channel.select(*loose, *(F.col(v).alias(f"_y_{v}") for v in values), F.lit(True).alias("_y"))
    joined = left.join(hit, exact, "left").join(channel, loose, "left")
    match = F.when(F.col("_x"), "exact").when(F.col("_y"), "channel").otherwise("none")
    rows = joined.select(*left.columns, *(F.coalesce(f"_x_{v}", f"_y_{v}").alias(v) for v in values), match.alias("match"))
    rest = right.join(left.select(*exact), exact, "left_anti")
    for c, v in loose_value.items():
        rest = rest.where(F.col(c) != v)
    return rows.unionByName(rest.select(*exact, *values, F.lit("unlisted").alias("match")), allowMissingColumns=True)


def neighbours(df: DataFrame, group: list, order: list, text: str, n: int) -> DataFrame:
    """Arrays before and after of the texts of up to n rows on either side in the group."""
    w = Window.partitionBy(*_columns(group)).orderBy(*_columns(order))
    return df.withColumn("before", F.collect_list(text).over(w.rowsBetween(-n, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, n)))


def near_in_time(df: DataFrame, seen: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows of df for which seen has no row of the same key within so many seconds.

    Both sides are cut into spans of that length and joined on them too, so that a key with many rows meets only its
    neighbours in time.
    """
    us = F.unix_micros(F.col(ts))
    span = F.floor(us / (seconds * 1_000_000))
    a = df.withColumn("_span", span).alias("a")
    b = seen.select(key, ts, F.explode(F.array(span - 1, span, span + 1)).alias("_span")).alias("b")
    close = F.abs(F.unix_micros(F.col(f"a.{ts}")) - F.unix_micros(F.col(f"b.{ts}"))) <= seconds * 1_000_000
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._span") == F.col("b._span")) & close, "left_anti").drop("_span")


def budget(df: DataFrame, group: list, order: list, cost: str, limit: int) -> DataFrame:
    """Rows that start before the costs of those before them reach the limit; the last one may go beyond it."""
    w = Window.partitionBy(*_columns(group)).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("_spent") < limit).drop("_spent")


def request_hash(**fields: Column) -> Column:
    """The hash of a request as JSON with sorted names; equal requests have equal hashes."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def replay(asked: DataFrame, recorded: DataFrame, key: str, answer: str) -> DataFrame:
    """asked with the recorded answers; the job fails if one isn't there."""
    hit = recorded.select(key, answer, F.lit(True).alias("_hit"))
    miss = F.raise_error(F.concat(F.lit("no record of request "), F.coalesce(F.col(key), F.lit("null"))))
    joined = asked.join(hit, key, "left")
    return joined.withColumn(answer, F.when(F.col("_hit"), F.col(answer)).otherwise(miss.cast(recorded.schema[answer].dataType))).drop("_hit")


def inherit(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with null values filled from rows of equal key (the largest); rows whose key is null inherit nothing."""
    known = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias("_known"))
    return df.join(known, key, "left").withColumn(value, F.coalesce(value, "_known")).drop("_known")


def weight_batches(weights: Column, most: int) -> Column:
    """For each weight of an array the number of its batch; batches are filled in turn, one that is too heavy is alone."""
    start = F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("held"), F.array().cast("array<long>").alias("out"))

    def put(s, w):
        fresh = (s["batch"] < 0) | (s["held"] + w > most)
        batch = F.when(fresh, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), F.when(fresh, w).otherwise(s["held"] + w).alias("held"), F.array_append(s["out"], batch).alias("out"))

    return F.aggregate(weights.cast("array<long>"), start, put, lambda s: s["out"])


def assign_nearest(left: Column, right: Column, most: int) -> Column:
    """Pairs (i, j, distance) of two arrays of structs (place, print): each left one, in order, takes the nearest right one.

    A right one is taken once, only up to a distance of most bits; among equals the one of the same place comes first,
    then the earlier one. The arrays are those of one item, sorted by place.
    """

    def one(done: Column, x: Column) -> Column:
        free = F.filter(right, lambda y: ~F.exists(done, lambda d: d["j"] == y["place"]))
        near = F.transform(free, lambda y: F.struct(F.bit_count(x["print"].bitwiseXOR(y["print"])).cast("int").alias("distance"), (y["place"] != x["place"]).alias("other"), y["place"].alias("j")))
        best = F.array_min(F.filter(near, lambda y: y["distance"] <= most))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(F.struct(x["place"].alias("i"), best["j"].alias("j"), best["distance"].alias("distance")))))

    none = F.array().cast("array<struct<i:int,j:int,distance:int>>")
    return F.aggregate(left, none, one)


def candidates(raw: DataFrame, collector: str) -> DataFrame:
    """Posts as a collector gives them (see the columns below) in the form that all later steps read.

    media keep their order as `ordinal`, what isn't a photo is a video; times and counts that can't be read are null;
    tags without a name are dropped.
    """
    photo = lambda m: F.when(F.lower(m["type"]) == "photo", "photo").otherwise("video")
    media = F.transform("media", lambda m, i: F.struct(m["hash"].alias("source_hash"), photo(m).alias("kind"), m["url"].alias("url"), i.alias("ordinal")))
    named = lambda c: F.filter(c, lambda t: F.coalesce(t, F.lit("")) != "")
    return raw.select(
        candidate_key(F.col("account"), F.col("url"), F.col("post_id")).alias("candidate_key"),
        F.lit(collector).alias("collector"), "account", "url", F.col("post_id").alias("source_id"), F.col("description").alias("text"),
        *(F.col(c).try_cast("timestamp").alias(n) for c, n in (("date_posted", "posted_at"), ("ingested_at", "ingested_at"))),
        *(F.col(c).try_cast("bigint").alias(c) for c in ("likes", "comments", "followers")),
        media.alias("media"), named("tags").alias("tags"), named("hashtags").alias("hashtags"),
    )


def merge_posts(published: DataFrame, mass: DataFrame, drafts: DataFrame, since: Column) -> DataFrame:
    """post_id, title, at and state of published posts, mass-sent ones that aren't among them, and drafts.

    Columns are post_id, title, at and deleted. A published post counts as seen even if it is deleted or old; then it isn't in the result.
    """
    cols = ["post_id", "title", "at"]
    live = lambda df, state: df.where(~F.coalesce("deleted", F.lit(False)) & (F.col("at") >= since)).select(*cols, F.lit(state).alias("state"))
    sent = live(mass, "published").join(published.select("post_id"), "post_id", "left_anti").dropDuplicates(["post_id"])
    draft = live(drafts, "draft").withColumn("post_id", F.concat(F.lit("draft:"), "post_id"))
    return live(published, "published").unionByName(sent).unionByName(draft)


def collect_sources(sources: list[tuple[str, DataFrame | None, bool]]) -> DataFrame:
    """The rows of sources (name, rows, required) with their `source` and whether the sweep is `partial`.

    rows is None where a source is switched off: the sweep is partial then, and a ValueError if the source is required.
    """
    off = [name for name, rows, _ in sources if rows is None]
    needed = [name for name, rows, required in sources if rows is None and required]
    if needed or len(off) == len(sources):
        raise ValueError(f"required sources are off: {', '.join(needed or off)}")
    every = None
    for name, rows, _ in sources:
        if rows is not None:
            own = rows.withColumn("source", F.lit(name)).withColumn("partial", F.lit(bool(off)))
            every = own if every is None else every.unionByName(own)
    return every


def sample_pairs(rows: DataFrame, key: str, account: str, brand: str, n: int, buckets: int = 64) -> DataFrame:
    """bucket, i and j: up to n pairs each of one account and brand, of one brand, and of different brands.

    Rows lie in the order of their keys' hashes within so many spans of it, and neighbours there are the pairs to draw
    from; so there are at most three a row, no group is paired in full, and a hot brand is spread over the spans. Of
    these the first n by their hash are taken.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    span = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    base = rows.select(F.col(key).alias("_k"), F.col(account).alias("_a"), F.col(brand).alias("_b"), digest.alias("_h"), span.alias("_s")).where("_b IS NOT NULL")
    every = None
    for name, part, good in (
        ("same_account", ["_b", "_a", "_s"], F.lit(True)),
        ("cross_account", ["_b", "_s"], F.col("_a") != F.col("_next._a")),
        ("unrelated", ["_s"], F.col("_b") != F.col("_next._b")),
    ):
        w = Window.partitionBy(*part).orderBy("_h", "_k")
        near = base.withColumn("_next", F.lead(F.struct("_k", "_a", "_b")).over(w)).where(F.col("_next").isNotNull() & good)
        pairs = near.select(F.lit(name).alias("bucket"), F.least("_k", "_next._k").alias("i"), F.greatest("_k", "_next._k").alias("j"))
        order = F.sha2(F.concat_ws("-", "i", "j"), 256)
        drawn = pairs.orderBy(order, "i", "j").limit(n)
        every = drawn if every is None else every.unionByName(drawn)
    return every


def memory_picks(asked: DataFrame, cases: DataFrame, sims: DataFrame, per_decision: int = 3, cross: int = 2, least: float = 0.30) -> DataFrame:
    """asked, case and cross_brand: earlier cases shown beside each request (asked, brand, url; one row for each of its brands).

    Cases (case, brand, url, decision, place) of one of its brands come first, up to per_decision of those adopted and of
    the others; then the most similar ones of other brands by sims (asked, case, sim), up to `cross` of each kind and
    while the first limit has room. A request's own address is left out.

    A request never joins all cases of a brand. Of one address a brand shows per_decision cases at most, and of twice as
    many that come first after this cut, at least per_decision have another address than a request: these stand for the brand.
    """
    rows = cases.withColumn("kind", F.col("decision") == "adopted")
    brands = asked.select("asked", "brand").distinct()
    urls = asked.select("asked", F.col("url").alias("_own")).distinct()
    other = (F.coalesce("_own", F.lit("")) == "") | ~F.col("url").eqNullSafe(F.col("_own"))
    front = rows.where("trim(brand) <> ''").select("brand", "case", "kind", "url", "place")
    for keys, n in ((["brand", "kind", "url"], per_decision), (["brand", "kind"], 2 * per_decision)):
        front = top_per_key(front, keys, ["place", "case"], n).drop("rank")
    front = materialize(front, "front")
    own = brands.join(urls, "asked").join(front, "brand").where(other).select("asked", "case", "kind", "place")
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("asked", "kind").orderBy("place", "case"))).where(F.col("_n") <= per_decision)
    held = first.groupBy("asked", "kind").agg(F.count("*").alias("held"))
    near = sims.where(F.col("sim") >= least).join(rows, "case").join(brands, ["asked", "brand"], "left_anti").join(urls, "asked").where(other)
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("asked", "kind").orderBy(F.desc("sim"), "place", "case"))).where(F.col("_n") <= cross)
    more = best.join(held, ["asked", "kind"], "left").where(F.col("_n") + F.coalesce("held", F.lit(0)) <= per_decision)
    return first.select("asked", "case", F.lit(False).alias("cross_brand")).unionByName(more.select("asked", "case", F.lit(True).alias("cross_brand")))


def reconcile(old: DataFrame, lines: DataFrame, book: str, key: str, content: str) -> DataFrame:
    """What to do so that the books that lines has hold just its lines: action, key and content.

    action is insert, update (the content differs, null included), same or delete (a row of one of these books that has
    no line). An orphan action names content that old rows lose and that no row has afterwards, of any book, with a null
    key. Rows of other books stay. Keys tell rows apart on either side; a key that another book had moves.
    """
    new = lines.select(F.col(key).alias("_k"), F.col(book).alias("_b"), F.col(content).alias("_new"), F.lit(True).alias("_line"))
    covered = lines.select(book).distinct()
    had = old.select(F.col(key).alias("_k"), F.col(book), F.col(content).alias("_old"), F.lit(True).alias("_row"))
    had = had.join(covered.withColumn("_covered", F.lit(True)), book, "left").drop(book)
    both = had.join(new, "_k", "full")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    action = F.when(F.col("_row").isNull(), "insert").when(F.col("_line").isNull(), F.when(F.col("_covered"), "delete").otherwise("other")).when(same, "same").otherwise("update")
    judged = materialize(both.withColumn("action", action), "reconciled")
    after = judged.where("action <> 'delete'").select(F.when(F.col("_line").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias("content"))
    lost = judged.where("action IN ('delete', 'update') AND _old IS NOT NULL").select(F.col("_old").alias("content")).distinct()
    orphans = lost.join(after, "content", "left_anti").select(F.lit("orphan").alias("action"), F.lit(None).cast(old.schema[key].dataType).alias(key), F.col("content").alias(content))
    done = judged.where("action <> 'other'").select("action", F.col("_k").alias(key), F.when(F.col("_line").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias(content))
    return done.unionByName(orphans)
