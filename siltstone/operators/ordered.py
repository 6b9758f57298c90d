"""Ranks and running totals over whole tables without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Partitions whose totals one task of running_total adds up.
FAN = 1000


def rank_in_group(df: DataFrame, group: list[str], key: list[str], rows: int, per_bucket: int = 20_000, place: Column | None = None) -> DataFrame:
    """Add rank: 0, 1, 2, ... within each group, in an order that is fixed by key but otherwise free.

    place, from 0 up to 1, evenly spread and rising with key, makes it the order of key. A group is cut into buckets by
    place, or else by the hash of key, so that one that holds a third of all rows is shared by many tasks;
    counts of the buckets, not rows, are added up. df has to give the same rows again if it is computed again.
    """
    buckets = max(1, -(-rows // per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)) if place is None else F.floor(place * buckets))
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*group, "_bucket").orderBy(*key)
    ranked = df.withColumn("_rank", F.row_number().over(own) - 1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_bucket"]]
    joined = ranked.alias("a").join(counts.alias("b"), same)
    return joined.select("a.*", "b._base").withColumn("rank", F.col("_rank") + F.col("_base")).drop("_rank", "_base", "_bucket")


def running_total(df: DataFrame, part: str, order: str, value: str | Column, out: str) -> DataFrame:
    """Add out: the sum of value over all rows before each, in the order of (part, order).

    part is a number that rises with the order, of which each has few enough rows for one task, such as the partition
    of a range-partitioned table. Totals of parts are added up in blocks of FAN parts, those in one task.
    """
    value = F.col(value) if isinstance(value, str) else value
    totals = df.groupBy(part).agg(F.sum(value).alias("_v")).withColumn("_block", F.floor(F.col(part) / FAN))
    blocks = totals.groupBy("_block").agg(F.sum("_v").alias("_b"))

    def before(window):
        return window.rowsBetween(Window.unboundedPreceding, -1)

    blocks = blocks.withColumn("_from", F.coalesce(F.sum("_b").over(before(Window.orderBy("_block"))), F.lit(0))).drop("_b")
    inner = F.coalesce(F.sum("_v").over(before(Window.partitionBy("_block").orderBy(part))), F.lit(0))
    bases = totals.withColumn("_in", inner).join(blocks, "_block").select(part, (F.col("_in") + F.col("_from")).alias("_base"))
    own = F.coalesce(F.sum(value).over(before(Window.partitionBy(part).orderBy(order))), F.lit(0))
    return df.withColumn("_own", own).join(bases, part).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base")


def in_order(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """A written table: df with rank (0, 1, 2, ... within each group in the given order), size (the group's rows), and,
    for each name in sums, the sum of its column over the earlier rows of the group.

    Rows are dealt into ranges of (group, order), so that a group of any size is shared by many tasks, as long as order
    tells its rows apart. Only counts and sums of each group in each range, few for any group, are carried over; a row
    meets those of its own range. Null is a group of its own. Rows that order doesn't tell apart take any order.
    Of equal rows, then, which has which rank is free.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df.coalesce(1)
    rows = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sums = sums or {}
    parts = rows.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_in").alias("_first"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each range that has the group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("size")]
    carried += [F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums]
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    bases = parts.select(F.col("_part").alias("_p"), *named, "_first", *carried)
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy("_part", *group).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_own_{k}": F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()})
    rank = (F.col("_in") - F.col("_first") + F.col("_base")).alias("rank")
    totals = [(F.col(f"_own_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums]
    return materialize(rows.join(bases, same).select(*df.columns, rank, "size", *totals), "ranked")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last row of right with equal `by` whose `at` isn't later (strict: is earlier).

    Null where there is none; of right rows at one `at` the one with the greatest values counts. Both sides, united, are
    dealt into ranges of (by, at), so that a key of any size is shared by many tasks; each range takes over the last
    right row before it from the ranges of the same key, of which a row each is compared. Null is a key like others;
    rows of right with a null `at` are left out, those of left get nothing. Rows of left that are alike stay apart.
    """
    kept = [x for x in left.columns if x not in values]
    mine = F.struct(*[F.col(x) for x in kept]).alias("_left")
    theirs = F.struct(F.col(at).alias("_w"), *[F.col(x) for x in values]).alias("_right")
    none = F.lit(None)
    shape = right.select(theirs).schema["_right"].dataType
    after, before = (0, 1) if strict else (1, 0)
    lefts = left.select(*by, F.col(at).alias("_t"), F.lit(after).alias("_side"), mine, none.cast(shape).alias("_right"))
    rights = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_t"), F.lit(before).alias("_side"), none.cast(lefts.schema["_left"].dataType).alias("_left"), theirs)
    order = [*[F.col(x).asc_nulls_first() for x in by], F.col("_t").asc_nulls_first(), F.col("_side"), F.col("_right")]
    both = lefts.unionByName(rights)
    spread = F.xxhash64(F.to_json("_left"))  # so that one time with many rows isn't one range
    rows = materialize(both.repartitionByRange(*order, spread).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "as-of")
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    ends = rows.where("_right IS NOT NULL").groupBy("_part", *by).agg(F.max_by("_right", "_at").alias("_end"))
    places = rows.select("_part", *by).distinct()
    same = lambda a, b: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in ["_part", *by]]
    carried = places.alias("p").join(ends.alias("e"), same("p", "e"), "left").select("p.*", "e._end")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = carried.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    own = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_own", F.last("_right", ignorenulls=True).over(own)).where("_left IS NOT NULL")
    joined = filled.alias("f").join(carried.alias("c"), same("f", "c")).select("f._left", "f._t", F.coalesce("f._own", "c._carried").alias("_found"))
    found = F.when(F.col("_t").isNotNull(), F.col("_found"))
    return joined.select(*[F.col(f"_left.{x}").alias(x) for x in kept], *[found[x].alias(x) for x in values])
