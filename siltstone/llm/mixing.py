"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source, each source gets a share of all sizes by its weight but no more than `most` times its own
size, and each document is emitted floor(rate) times plus once more with the probability of the fraction, where rate is
target / size of its source.

The extra copies are Bernoulli draws from hashes of the seed, so that reruns and retried tasks agree, but not independent
ones, which would leave a source with a few long documents far from its target: they are systematic along the sizes of a
source's documents. With the documents in the order of size and one hashed offset for the source, every 1 / fraction-th
one gets a copy; among documents of equal size those with the smallest hashes of doc_id do. Each document still has the
probability of the fraction, and the copies' words are off by one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.batches import text_of
from siltstone.operators.ordered import rank_in_group
from siltstone.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 17
#: Rows, of 100 bytes each, up to which a table of sources, or of sources and sizes, is sent to every executor; a larger one is
#: joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Rows of a source and a size that one task ranks.
PER_BUCKET = 20_000


def sizes_of() -> list[Column]:
    """doc_id, source and size, the number of words; a null text has none."""
    return [F.col("doc_id"), F.col("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")]


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(*sizes_of())


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, weight, target, rate.

    Sources take the weights in turn in the order of their code points, null last. What a source can't take, because
    its target would be over most times its size, is shared among the others by weight. With the sources in the order
    of size / weight, the level at which the first k are full rises until all that are over are full and falls from
    then on; so its maximum is the one that holds. Only one row for each source is in these windows. A source without
    words has target 0 and rate 1.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.sum("source_size").over(every).cast("double") - full) / open_)
    per = per.withColumn("_level", F.max("_level").over(every))
    target = F.least(F.col("_cap"), F.col("_level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), target / F.col("source_size"))).otherwise(1.0)
    return per.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def draw(key: Column, seed: int = SEED, kind: str = "") -> Column:
    """A number from 0 up to 1 from the seed and key; a null key draws like an empty one."""
    text = F.concat(F.lit(f"{seed}:{kind}"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cuts(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """source, size and cut: documents of that size whose draw is up to cut get one more copy.

    sized and targets are written tables; only rows with doc_id, source and size, never texts, are shuffled. The
    documents of a source are counted by size, so a window over a source has a row for each size, not for each
    document. A size that many documents have, such as that of a group of copies, is ranked in many tasks.
    """
    draws = sized.select("doc_id", F.col("source").alias("_source"), "size")
    joined = draws.join(_small(targets.select("source", "rate")), F.col("_source").eqNullSafe(F.col("source")))
    rows = joined.withColumn("f", F.col("rate") - F.floor("rate")).where("f > 0").select("doc_id", "source", "size", "f", draw(F.col("doc_id"), seed).alias("u"))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("f").alias("f"))
    per = per.withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0)))
    start = draw(F.col("source"), seed, "source:")
    upto = lambda x: F.floor(x * F.col("f") + start)
    per = per.withColumn("m", upto(F.col("b") + F.col("n")) - upto(F.col("b"))).where("m > 0").select("source", "size", "m")
    ranked = rank_in_group(rows.drop("f"), ["source", "size"], ["u", "doc_id"], sized.count(), PER_BUCKET, F.col("u"))
    last = ranked.alias("a").join(per.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    return last.where("rank = m - 1").select("a.source", "a.size", F.col("u").alias("cut"))


def _small(rows: DataFrame) -> DataFrame:
    """rows, a written table, broadcast if it has few enough, counted first."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def with_copies(docs: DataFrame, sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, which has doc_id, source and size, with source_size, target and copies, the times that each is emitted.

    sized, of which docs are the rows, and targets are written tables. Where sources, and sizes of their documents, are
    few, counted first, they go to every executor and docs aren't shuffled; else Spark joins by source and size and
    splits a key that holds many rows.
    """
    extra = _small(materialize(cuts(sized, targets, seed), "cuts").select(F.col("source").alias("_s"), F.col("size").alias("_n"), "cut"))
    known = _small(targets.select(F.col("source").alias("_source"), "source_size", "target", "rate"))
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.join(extra, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")), "left")
    more = F.when(draw(F.col("doc_id"), seed) <= F.col("cut"), 1).otherwise(0)
    return rows.withColumn("copies", (F.floor("rate") + more).cast("long")).drop("_source", "_s", "_n", "cut", "rate")


def taken(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes from each row, repeats counted.

    A null or empty text has size 0; a null doc_id draws like an empty one, a null source is a source, the last one. An
    empty table gives no rows. Rows with equal doc_id, source and size, repeated rows among them, are taken alike.
    """
    sized = materialize(sizes(docs), "sizes")
    rows = with_copies(sized, sized, materialize(source_targets(sized, weights, most), "targets"), seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, with its columns, each as often as the mix takes it; cases as in taken().

    docs may have any other columns. A document of size 0 is emitted floor(rate) times, or once in a source without
    words, or once more where its draw says so.
    """
    sized = materialize(sizes(docs), "sizes")
    targets = materialize(source_targets(sized, weights, most), "targets")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *sizes_of())
    rows = with_copies(own, sized, targets, seed).where("copies > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_nth")).select("_row.*")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM per),
level AS (
  SELECT max((total - full_before) / open_weight) AS level FROM (
    SELECT sum(source_size) OVER ()::DOUBLE AS total,
      coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
    FROM weighed)),
rated AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, least(3.0::DOUBLE * source_size, level * weight) / source_size) ELSE 1.0::DOUBLE END AS rate,
    ('0x' || substr(md5('17:source:' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS start FROM weighed, level),
drawn AS (SELECT s.doc_id, s.source, s.size::BIGINT AS size, source_size, target, rate,
    ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN rated ON s.source IS NOT DISTINCT FROM rated.source),
grouped AS (SELECT source, size, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT source, size, count(*) AS n FROM drawn GROUP BY ALL)),
extra AS (SELECT g.source, size, floor((before + n) * (rate - floor(rate)) + start) - floor(before * (rate - floor(rate)) + start) AS m FROM grouped g JOIN rated ON g.source IS NOT DISTINCT FROM rated.source),
ranked AS (SELECT *, rank() OVER (PARTITION BY source, size ORDER BY u) AS r FROM drawn)
SELECT doc_id, d.size, source_size, target, (d.size * (floor(rate)::BIGINT + CASE WHEN r <= m THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked d JOIN extra e ON d.source IS NOT DISTINCT FROM e.source AND d.size = e.size
"""
