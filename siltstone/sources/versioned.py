"""A table of keyed rows with versioned commits: a change is made on a version and committed only if none came between."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.session import discard, materialize


class Conflict(Exception):
    """Another writer has committed the version first."""


class VersionedTable:
    """Rows in buckets of their key. A version names a folder for each bucket; a commit writes the buckets that it
    changes and takes over the others, so that it costs in proportion to what it touches. Old versions stay readable."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        where = self._path(f"{self.root}/versions")
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        return max((int(x.getPath().getName()) for x in found if x.getPath().getName().isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"{self.root} has no version yet")
        manifest = self._manifest(version)
        schema = StructType.fromJson(manifest["schema"])
        paths = [p for b, p in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def commit(self, rows: DataFrame, version: int, kept: dict[str, str]) -> None:
        """Make rows, with the folders of the buckets in kept, this version; Conflict if it is there already."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        dealt = rows.withColumn("_bucket", self._bucket())
        dealt.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(folder)
        written = self._fs.listStatus(self._path(folder))
        new = {x.getPath().getName().removeprefix("_bucket="): f"{folder}/{x.getPath().getName()}" for x in written if x.getPath().getName().startswith("_bucket=")}
        text = json.dumps({"schema": json.loads(rows.schema.json()), "buckets": kept | new})
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        draft = self._path(f"{self.root}/versions/draft-{name}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the version is there
        try:
            context.rename(draft, self._path(f"{self.root}/versions/{version:012d}"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(folder), True)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there") from e
            raise

    def create(self, rows: DataFrame) -> None:
        """The first version; key tells its rows apart."""
        self.commit(rows, 1, {})

    def update(self, change: Callable[[DataFrame], DataFrame], delete: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Put in the rows that change makes of the table and take out the keys that delete makes of it; the rows put in.

        Both are functions of a version's rows. If another writer commits first, they are evaluated again on the version
        that then stands, so that what they saw is what they change. Rows put in replace those of equal key. Where
        nothing changes, nothing is committed. Which buckets change, as many as there are at most, goes to the driver.
        """
        while True:
            version = self.version()
            rows = self.read(version)
            new = materialize(change(rows), "changes")
            gone = new.select(*self.key) if delete is None else new.select(*self.key).unionByName(delete(rows).select(*self.key))
            gone = materialize(gone.distinct(), "keys")
            touched = [r[0] for r in gone.select(self._bucket()).distinct().collect()]
            if not touched:
                return new
            stay = self.read(version, touched).join(gone, self.key, "left_anti")
            kept = {b: p for b, p in self._manifest(version)["buckets"].items() if int(b) not in touched}
            try:
                self.commit(stay.unionByName(new.select(*rows.columns)), version + 1, kept)
                discard(gone)
                return new
            except Conflict:
                discard(gone, new)


def claim(table: VersionedTable, owner: str, now, limit: int, lease_minutes: int, key: str = "id") -> DataFrame:
    """The first `limit` rows by key that are pending, due (next_at) and not claimed, or claimed a lease ago; claimed for owner at now.

    The table has status, next_at, claimed_at and owner. Of two claimers of the same rows one commits first; the other
    then finds them claimed and takes those that are left, so that each row has one owner at a time.
    """
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") <= now - F.make_dt_interval(mins=F.lit(lease_minutes)))
    due = (F.col("status") == "pending") & (F.col("next_at") <= now) & free

    def change(rows: DataFrame) -> DataFrame:
        return rows.where(due).orderBy(key).limit(limit).withColumn("claimed_at", now).withColumn("owner", F.lit(owner))

    return table.update(change)


def notify_once(table: VersionedTable, due: DataFrame, key: str, mark: str, now) -> DataFrame:
    """The rows of due (key) whose mark isn't set yet in the table, with the mark then set; so each is told once."""
    return table.update(lambda rows: rows.where(F.col(mark).isNull()).join(due.select(key).distinct(), key, "left_semi").withColumn(mark, now))
