"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where it is unset and the master is local, a temporary folder is set instead.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the scratch folder and read it back.

    Cuts lineage with files that outlive any executor; unlike a cache, nothing has to be computed again.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote, once no plan that is still to run reads it. Other tables are left alone."""
    for df in tables:
        if path := df.__dict__.pop("_scratch_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
