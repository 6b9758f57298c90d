"""Lenient scans of text files and a JSON-lines sink; what is bad is kept beside what is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.text import number


def json_lines(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and lines (value, reason) that are malformed or lack one; blank lines count as neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("broken"))
    reason = F.when(F.col("broken"), "malformed")
    for name in required:
        reason = reason.when(F.col(f"r.{name}").isNull(), f"no {name}")
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("r.*"), judged.where("reason IS NOT NULL").select("value", "reason")


def manifest(spark: SparkSession, path: str, schema: StructType, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Lines of manifests under path, in any depth, that pass all checks in order, and the others with the first failed one."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = lines.where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("r"))
    flat = rows.select("value", "file", "r.*")
    reason = None
    for name, good in checks.items():
        bad = ~F.coalesce(good, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    flat = flat.withColumn("reason", F.lit(None).cast("string") if reason is None else reason)
    return flat.where("reason IS NULL").drop("reason", "value"), flat.where("reason IS NOT NULL").select("file", "value", "reason")


def aliased_csv(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """A CSV with its known headers under their own names, without a byte order mark; the others in the map `raw`."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    names = {c: aliases.get(c.strip().lstrip("﻿").lower()) for c in df.columns}
    known = [F.col(f"`{c}`").alias(n) for c, n in names.items() if n]
    other = [x for c, n in names.items() if not n for x in (F.lit(c), F.col(f"`{c}`"))]
    raw = F.create_map(*other) if other else F.create_map().cast("map<string,string>")
    return df.select(*known, raw.alias("raw"))


def daily_trend(spark: SparkSession, path: str, aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Sums of an account's CSV with one line a day: (name, known, total) for each header, and one row (first, last, flag).

    aliases lead from headers to date, follows, new_follows and unfollows. Cells that aren't numbers don't count, a
    header without any has no sum. flag is definition_pending where the net differs from new less lost.
    """
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    clean = {c: c.strip().lstrip("\ufeff").strip() for c in df.columns}
    known = {c: aliases.get(n.lower(), "") for c, n in clean.items()}
    cells = [F.struct(F.lit(clean[c]).alias("name"), F.lit(known[c]).alias("known"), number(F.col(f"`{c}`")).alias("value")) for c in df.columns if known[c] != "date"]
    cells = F.array(*cells) if cells else F.array().cast("array<struct<name:string,known:string,value:double>>")
    days = F.coalesce(*(F.col(f"`{c}`") for c in df.columns if known[c] == "date"), F.lit(None).cast("string"))
    totals = df.select(F.inline(cells)).groupBy("name", "known").agg(F.sum("value").alias("total")).where("total IS NOT NULL")
    net, new, lost = (F.max(F.when(F.col("known") == k, F.col("total"))) for k in ("follows", "new_follows", "unfollows"))
    flag = totals.agg(F.when(new - lost != net, "definition_pending").alias("flag"))
    span = df.agg(F.min(days).alias("first"), F.max(days).alias("last"))
    return totals, span.unionByName(flag, allowMissingColumns=True).agg(*(F.max(n).alias(n) for n in ("first", "last", "flag")))


def in_order(spark: SparkSession, table: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys, a short list of the caller's, with their place in it."""
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"`{key}` {dict(table.dtypes)[key]}, place int")
    return table.join(F.broadcast(keys), key).orderBy("place")


def mixed_time(text: Column) -> Column:
    """A timestamp from text or from seconds since 1970; null for anything else."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("double")), text.try_cast("timestamp"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in the order of the columns, null fields left out."""
    df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value")).write.text(path)


def replace_partitions(df: DataFrame, path: str, parent: list[str]) -> None:
    """Replace the rows of the parents that df has; other parents' partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parent).parquet(path)
