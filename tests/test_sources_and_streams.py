import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from siltstone.sources import files
from siltstone.streaming import events as S
from tests.conftest import SF

SCHEMA = StructType().add("id", LongType()).add("title", StringType())


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "title": "x"}\n\n{bad\n{"title": "y"}\n')
    good, bad = files.json_lines(spark, str(tmp_path / "a.jsonl"), SCHEMA, ["id"])
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "no id"]


def test_manifests_in_folders(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "m.jsonl").write_text(f'{{"id": {k}, "title": "t"}}\n')
    good, bad = files.manifest(spark, str(tmp_path), SCHEMA, {"title": F.col("title") == "t", "id": F.col("id") > 0})
    assert [r.id for r in good.collect()] == [1] and [r.reason for r in bad.collect()] == ["id"]


def test_csv_headers_and_unknown_columns(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿Note ID,Views,Odd\n1,5,z\n2,6\n")
    rows = files.aliased_csv(spark, str(tmp_path / "n.csv"), {"note id": "post_id", "views": "views"}).orderBy("post_id").collect()
    assert [(r.post_id, r.views, r.raw) for r in rows] == [("1", "5", {"Odd": "z"}), ("2", "6", {"Odd": None})]


def test_lookup_keeps_the_order_and_times_are_lenient(spark):
    table = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in files.in_order(spark, table, "k", [7, 2, 99, 4]).collect()] == [7, 2, 4]
    row = spark.range(1).select(*(F.unix_seconds(files.mixed_time(F.lit(x))).alias(n) for n, x in (("a", "60"), ("b", "1970-01-01T00:02:00Z"), ("c", "no")))).first()
    assert tuple(row) == (60, 120, None)


def test_sinks(spark, tmp_path):
    files.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/j")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()] == [{"a": 1}]
    df = spark.createDataFrame([(1, 1), (2, 2)], "p int, v int")
    files.replace_partitions(df, f"{tmp_path}/p", ["p"])
    files.replace_partitions(df.where("p = 1").withColumn("v", F.lit(9)), f"{tmp_path}/p", ["p"])
    assert sorted((r.p, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, 9), (2, 2)]


def test_streams_give_the_rows_of_the_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.event_stream(spark, f"{tmp_path}/in", table.schema, 1)
    S.run_now(S.keep_first(stream, ["user_id", "event_type"], late="60 days"), f"{tmp_path}/c1", S.write_batches(f"{tmp_path}/o1"))
    assert spark.read.parquet(f"{tmp_path}/o1").count() == table.select("user_id", "event_type").distinct().count()
    S.run_now(S.window_counts(stream, "event_type", late="60 days"), f"{tmp_path}/c2", S.write_batches(f"{tmp_path}/o2"), "complete")
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "o2").glob("batch=*"))
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/o2/batch={last}").select("start", "event_type", "n").collect()}
    want = table.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert got == {tuple(r) for r in want.collect()}
