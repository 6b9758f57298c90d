"""Prints of 64 bits and pairs of them that differ in a few bits."""

from __future__ import annotations

import math
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

ROWS, CELLS = 8, 9


def row_print(cells: Column) -> Column:
    """A print of 8 rows of 9 brightnesses, an array of 72: a bit for each that is brighter than the next in its row."""
    bit = lambda i: F.when(F.get(cells, i + F.floor(i / 8).cast("int")) > F.get(cells, i + F.floor(i / 8).cast("int") + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(bit(i)))


def text_cells(text: Column, letter: str, start: float = 0.0, end: float = 1.0) -> Column:
    """How often 72 equal slices of a part of the text have a letter, as its picture in 8 rows of 9 cells.

    A text is gone through once: its characters can't be addressed in UTF-8, so a column's substr starts anew for each slice.
    """

    def counts(t: str | None) -> list[int | None]:
        if t is None:
            return [None] * (ROWS * CELLS)
        first = math.floor(len(t) * start)
        size = math.floor(len(t) * end) - first
        cut = [first + size * i // (ROWS * CELLS) for i in range(ROWS * CELLS + 1)]
        return [t.count(letter, a, b) * len(letter) for a, b in pairwise(cut)]

    @F.pandas_udf("array<int>")
    def cells(texts: pd.Series) -> pd.Series:
        return texts.map(counts)

    return cells(text)


def near_prints(rows: DataFrame, bits: int, key: str = "id", value: str = "print") -> tuple[DataFrame, DataFrame]:
    """Pairs of different prints within `bits` bits, and which rows have a print.

    The first table has a, b and distance, each print named by the smallest key that has it; the second has the key and
    `first`, that smallest key. Copies so make no pairs. A print is cut into bits // 2 + 1 parts: two prints within
    `bits` bits differ by one bit at most in some part. So each print is filed under its parts, looked up under them and
    under those one bit away, and only what meets is compared. A row may have several prints; rows without are left out.
    """
    parts = bits // 2 + 1
    width = -(-64 // parts)
    named = materialize(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("p")).agg(F.min(key).alias("first")), "prints")
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    places = F.sequence(F.lit(0), F.lit(parts - 1))
    part = lambda i: F.call_function("shiftrightunsigned", F.col("p"), i * width).bitwiseAND(mask)
    filed = named.select("p", "first", F.explode(F.transform(places, lambda i: F.struct(i.alias("part"), part(i).alias("v")))).alias("x")).select("p", "first", "x.*")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    asked = filed.select(F.col("p").alias("q"), F.col("first").alias("a"), "part", F.explode(F.transform(flips, lambda f: F.col("v").bitwiseXOR(f))).alias("v"))
    distance = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    met = asked.join(filed, ["part", "v"]).where((F.col("a") < F.col("first")) & (F.col("p") != F.col("q")) & (distance <= bits))
    pairs = met.groupBy("a", F.col("first").alias("b")).agg(F.min(distance).alias("distance"))
    members = rows.join(named, rows[value].eqNullSafe(named["p"])).select(key, "first")
    return pairs, members
