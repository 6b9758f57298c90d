"""Structured Streaming forms of batch operators. `availableNow` runs give the batch forms' rows, but for late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def keep_first(events: DataFrame, key: list[str], ts: str = "ts", late: str = "7 days") -> DataFrame:
    """A row for each key; keys are remembered as long as rows may be late, so that state is bounded."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def window_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by tumbling window and key."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of rows of a key without a pause of gap."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_now(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Everything that is there, then stop. each(rows, batch id) has to be idempotent by batch id."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def write_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each batch, which a repeated batch overwrites."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return each
