"""Sharding with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shards. Shards of similar size are merged, a tier at a time, into files of
about the target size; old shards stay as they are for readers of older versions. A version is a manifest, a table of
shards, and becomes visible by one atomic rename of a small pointer that fails if the version is already there; who
loses that race puts its change on the version that won and tries again. Files of a job that was lost are in no
manifest and so never read; sweep() removes them.

Shards of a table may have different columns: each is read with the same schema, that of the table, so that a column
which a shard lacks is null and none is lost. The schema grows with appends and stands beside each version's manifest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of a finished file, rows of an arrival's shards, shards of like size that are merged, and ratio of tiers.
TARGET, ARRIVAL_ROWS, RUN, RATIO = 128 << 20, 2000, 4, 4
#: Bytes of the smallest tier's largest shards; shards merged in one commit, others follow in the next.
FIRST_TIER, PER_COMMIT = 4 << 20, 10_000

MANIFEST = "path string, bytes long, rows long"


class Conflict(RuntimeError):
    """Someone else has committed this version."""


class ShardedTable:
    """A folder in a store that all executors share: shards/, manifests/ and versions/.

    Rows keep all their columns and values, nulls, empty and long texts and repeated rows too. An empty table has no
    shards, and without a version no columns.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        where = self._path(f"{self.root}/versions")
        if not self._fs.exists(where):
            return 0
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(where) if x.getPath().getName().isdigit()), default=0)

    def _pointer(self, version: int) -> tuple[str, StructType]:
        """The folder of a version's manifest, and the table's schema in it."""
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}"))
        try:
            name, _, schema = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition("\n")
        finally:
            stream.close()
        return name, StructType.fromJson(json.loads(schema))

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._pointer(version)[0]}")

    def schema(self, version: int | None = None) -> StructType:
        """All columns of a version's shards, in the order in which they came."""
        version = self.version() if version is None else version
        return self._pointer(version)[1] if version else StructType()

    def commit(self, shards: DataFrame, version: int, schema: StructType) -> None:
        """Write the manifest, then make it this version with an atomic rename that doesn't overwrite."""
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.root}/manifests/{name}")
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        draft = self._path(f"{self.root}/versions/draft-{name}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(f"{name}\n{schema.json()}".encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path(f"{self.root}/versions/{version:012d}"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(f"{self.root}/manifests/{name}"), True)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there") from e
            raise

    def _retry(self, change: Callable[[int], tuple[DataFrame, StructType] | None], version: int) -> int:
        """Commit what change makes of a version, again on the next one as long as others come first.

        change returns the new manifest and schema, or None where it no longer applies; the last version then stays.
        """
        while True:
            if (new := change(version)) is None:
                return version
            try:
                self.commit(new[0], version + 1, new[1])
                return version + 1
            except Conflict:
                version = self.version()

    def _written(self, folder: str) -> DataFrame:
        """Shards of a finished job; their lengths and row counts come from the files' metadata."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", F.col("length").alias("bytes"))
        rows = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        name = F.element_at(F.split("path", "/"), -1)
        joined = files.withColumn("name", name).drop("path").join(rows.withColumn("name", name).drop("path"), "name", "left")
        return joined.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), "bytes", F.coalesce("rows", F.lit(0)).alias("rows"))

    def append(self, rows: DataFrame, most_rows: int = ARRIVAL_ROWS) -> int:
        """Add rows as new shards, cut where their partitions and most_rows cut them; without a shuffle. The version.

        New columns come to the end of the table's schema; columns are matched by name, without regard to case, and a
        column that is known has to keep its type. An arrival without rows adds its columns only.
        """
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        united(self.schema(), rows.schema)  # fails before anything is written
        rows.write.option("maxRecordsPerFile", most_rows).option("compression", "zstd").parquet(folder)
        new = self._written(folder).where("rows > 0")
        return self._retry(lambda v: (self.manifest(v).union(new), united(self.schema(v), rows.schema)), self.version())

    def compact(self, target: int = TARGET, run: int = RUN) -> int:
        """Merge runs of similarly sized shards until no tier has run of them; the last version.

        A merge reads the shards of a tier side by side, with the table's schema, and coalesces them into total / target
        files without a shuffle. Shards of half the target or more are finished. If someone else has merged one of the
        shards in the meantime, the merge is dropped and the next one is looked for. Only sums by tier and the paths of
        one commit's shards, at most PER_COMMIT, come to the driver.
        """
        while True:
            version = self.version()
            known = self.manifest(version)
            tier = F.greatest(F.lit(0), F.ceil(F.log(F.greatest("bytes", F.lit(1)) / F.lit(float(FIRST_TIER))) / F.log(F.lit(float(RATIO)))))
            open_ = known.where(F.col("bytes") < target // 2).withColumn("tier", tier)
            full = open_.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= run).orderBy("tier").first()
            if full is None:
                return version
            chosen = open_.where(F.col("tier") == full["tier"]).orderBy("path").limit(PER_COMMIT).select("path", "bytes").collect()
            files = max(1, round(sum(r["bytes"] for r in chosen) / target))
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            schema = self.schema(version)
            merged = self.spark.read.schema(schema).parquet(*(r["path"] for r in chosen))
            merged.coalesce(files).write.option("compression", "zstd").parquet(folder)
            gone = self.spark.createDataFrame([(r["path"],) for r in chosen], "path string")
            new = self._written(folder)

            def change(v, gone=gone, new=new, n=len(chosen)):
                now = self.manifest(v)
                if now.join(F.broadcast(gone), "path", "left_semi").count() < n:  # PER_COMMIT paths at most
                    return None
                return now.join(F.broadcast(gone), "path", "left_anti").select("path", "bytes", "rows").union(new), self.schema(v)

            self._retry(change, version)

    def read(self, schema=None, version: int | None = None) -> DataFrame:
        """The rows of a version, with the table's schema or another one. Spark gets the paths of its files, which are
        target-sized after compaction. A column that a shard lacks is null."""
        schema = self.schema(version) if schema is None else schema
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def sweep(self, keep: int = 1, older_than_s: float = 86_400) -> int:
        """Remove shards that none of the last keep versions names, and earlier versions; how many folders went.

        Folders that are younger than the grace period stay, since a job may be about to commit them.
        """
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        folder = F.regexp_extract("path", r"/shards/([0-9a-f]+)/[^/]*$", 1)
        used: set[str] = set()
        for v in kept:
            used |= {r[0] for r in self.manifest(v).select(folder).distinct().collect()}  # one for each commit
            used.add(self._pointer(v)[0])
        gone = 0
        where = self._path(f"{self.root}/versions")
        for x in self._fs.listStatus(where) if self._fs.exists(where) else []:
            name = x.getPath().getName()
            if name.isdigit() and int(name) not in kept:
                self._fs.delete(x.getPath(), False)
        for kind in ("shards", "manifests"):
            where = self._path(f"{self.root}/{kind}")
            for x in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if x.getPath().getName() not in used and x.getModificationTime() / 1000 <= time.time() - older_than_s:
                    self._fs.delete(x.getPath(), True)
                    gone += 1
        return gone


def united(a: StructType, b: StructType) -> StructType:
    """The columns of a, then those that only b has, all of them nullable; ValueError if a name has two types."""
    known = {f.name.lower(): f for f in a}
    for f in b:
        if (old := known.get(f.name.lower())) is None:
            known[f.name.lower()] = f
        elif old.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {old.dataType.simpleString()} in the table and {f.dataType.simpleString()} in the arrival")
    return StructType([StructField(f.name, f.dataType, True) for f in known.values()])


ORACLE = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"
