"""Operator 1: sharding with size-tiered compaction and a versioned manifest.

Every append is a run: its rows are written as small immutable Parquet shards and listed in a new manifest version. Runs
are never changed. Compaction sorts the shards of a version into size tiers (powers of FANOUT); where a tier has FANOUT
shards or more, they are packed in order into groups of TARGET_BYTES, each group is written as one shard, and the next
version lists the new shards in place of the old ones. Shards that have their target size are never touched again.

A version is a Parquet table of shards plus one commit file that names it and holds the rows' schema. The commit file is
written under a name of its own and then renamed, never over an existing file: of two writers one fails and starts again
from the newer version, and a reader sees a version whole or not at all. Runs and shards whose version was never committed
are invisible. (On a local file system, as in tests, the check for an existing file and the rename are two steps.)

Manifests are DataFrames; planning takes a row per open shard, in one task for the order of a tier. A reader gets the
paths of the listed files and opens no others, so the driver holds a path per shard, as Spark's file index does anyway.
The size of a shard is that of its texts in bytes, which does not depend on compression.

Edge cases: null texts count as zero bytes; rows without a text column count with all their columns as JSON; a row larger
than the target is a shard of its own; all columns of the rows are kept under their names, whatever they are called, and
where a row has a column named like one of those that a located read adds, the added one gets a trailing underscore;
columns that came with later appends are null in earlier rows; an empty append commits a version without new shards; a
tier of fewer than FANOUT shards waits; repeated rows stay repeated.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lithos.llm.shared import shared_dir, stored, table

TARGET_BYTES = 64 << 20
FANOUT = 4
ARRIVALS = 8
MANIFEST = "path string, bytes long, n_rows long"


class VersionConflict(RuntimeError):
    """Another writer committed the version first."""


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many trailing underscores as keep it apart from the names taken, in any case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._hadoop, self._path, self._conf = hadoop, hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(x) for x in names if x.isdecimal())

    def _committed(self, version: int) -> tuple[str, StructType]:
        """A version's manifest and the schema of its rows."""
        f = self._fs.open(self._path(f"{self.path}/_commits/{version:012d}"))
        try:
            name, schema = bytes(f.readAllBytes()).decode().split("\n", 1)
        finally:
            f.close()
        return name, StructType.fromJson(json.loads(schema))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the newest by default."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifests/{self._committed(version)[0]}")

    def schema(self, version: int | None = None) -> StructType:
        """The schema of the rows of a version; without columns where none is committed."""
        if version is None:
            version = max(self.versions(), default=None)
        return StructType() if version is None else self._committed(version)[1]

    def _commit(self, shards: DataFrame, schema: StructType, version: int) -> int:
        """Write a manifest and a commit file, then rename that to the version's name, which must be free."""
        name = f"{version:012d}-{uuid.uuid4().hex}"
        shards.select("path", "bytes", "n_rows").write.parquet(f"{self.path}/_manifests/{name}")
        new, final = self._path(f"{self.path}/_commits/.{name}"), self._path(f"{self.path}/_commits/{version:012d}")
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(f"{name}\n{schema.json()}".encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(new, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise VersionConflict(f"version {version} exists") from e
            raise
        return version

    def _rows(self, paths: list[str], schema: StructType) -> DataFrame:
        """The rows of files; columns that a file lacks are null."""
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, rows: DataFrame, part: str, run: str) -> None:
        """Write rows as a run, with a folder for each value of part."""
        rows.write.option("compression", "zstd").partitionBy(part).parquet(f"{self.path}/data/{run}")

    def _described(self, run: str, schema: StructType) -> DataFrame:
        """path, bytes, n_rows and part (the folder) of the files of a run."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/data/{run}")
        # a null text is empty
        size = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in schema.names else F.octet_length(F.to_json(F.struct(*schema.names)))
        files = rows.select(F.col("_metadata.file_path").alias("path"), size.cast("long").alias("bytes")).groupBy("path").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
        return stored(files.withColumn("part", F.regexp_extract("path", "=([^/=]*)/[^/]*$", 1)), "shards")

    def append(self, rows: DataFrame, arrivals=None) -> list[int]:
        """Write rows as a new run and commit it as the next version; with arrivals, a column that names the batch in which
        a row came, each batch is committed as a version of its own, in the order of the batches' names."""
        version, run = max(self.versions(), default=0), uuid.uuid4().hex
        old = self.schema()
        schema = StructType([*old, *(x for x in rows.schema if x.name not in old.names)])
        if rows.isEmpty():
            return [self._commit(self.manifest(), schema, version + 1)]
        part = free_name("arrival", rows.columns)
        self._write(rows.withColumn(part, F.lit(0) if arrivals is None else arrivals), part, run)
        shards, done = self._described(run, rows.schema), []
        for batch in sorted(r[0] for r in shards.select("part").distinct().collect()):
            done.append(self._commit(self.manifest().unionByName(shards.where(F.col("part") == batch).drop("part")), schema, version + len(done) + 1))
        return done

    def plan(self, shards: DataFrame) -> DataFrame:
        """path, bytes, n_rows, group: which shards are merged. Tiers are packed by running sums over shards, not rows;
        groups are numbered from 0."""
        tier = F.when(F.col("bytes") < 1, 0).otherwise(F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(self.fanout)))))
        open_ = shards.where(F.col("bytes") < self.target).withColumn("tier", tier.cast("int"))
        full = open_.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.fanout).drop("n")
        before = W.partitionBy("tier").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
        packed = open_.join(full, "tier").withColumn("pack", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / self.target))
        return packed.select("path", "bytes", "n_rows", (F.dense_rank().over(W.orderBy("tier", "pack")) - 1).alias("group"))

    def compact(self) -> int:
        """Merge once and commit; the version stays as it is where nothing is to be merged."""
        version, shards, schema = max(self.versions(), default=0), self.manifest(), self.schema()
        plan = stored(self.plan(shards), "plan")
        last = plan.agg(F.max("group")).first()[0]
        if last is None:
            return version
        run, groups = uuid.uuid4().hex, last + 1
        rows = self._rows([r[0] for r in plan.select("path").collect()], schema)
        # packed, so that no column of the rows can clash
        packed = rows.select(F.struct(*schema.names).alias("row"), F.col("_metadata.file_path").alias("path")).join(plan.select("path", "group"), "path")
        # a group is one task's and one file; tasks are named by number, so no two groups meet in one
        part = free_name("merged", schema.names)
        self._write(packed.repartitionById(groups, F.col("group").cast("int")).select("row.*", F.col("group").alias(part)), part, run)
        left = shards.join(plan.select("path"), "path", "left_anti")
        return self._commit(left.unionByName(self._described(run, schema).drop("part")), schema, version + 1)

    def read(self, version: int | None = None, located: bool = False) -> DataFrame:
        """The rows of a version; located adds shard (its path), shard_bytes and shard_rows."""
        shards, schema = self.manifest(version), self.schema(version)
        names = [free_name(x, schema.names) for x in ("shard", "shard_bytes", "shard_rows")]
        paths = [r[0] for r in shards.select("path").collect()]
        if not paths:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumns(dict(zip(names, (F.lit("").alias("shard"), F.lit(0).cast("long"), F.lit(0).cast("long")), strict=True))) if located else rows
        rows = self._rows(paths, schema)
        if not located:
            return rows
        packed = rows.select(F.struct(*schema.names).alias("row"), F.col("_metadata.file_path").alias("path")).join(shards, "path")
        return packed.select("row.*", *[F.col(x).alias(name) for x, name in zip(("path", "bytes", "n_rows"), names, strict=True)])


def arrival(doc_id, n: int = ARRIVALS):
    """The batch in which a document arrives: a hash of its id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def shard(docs: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append docs in their arrivals, compact, and read the newest version: the rows with shard, shard_bytes, shard_rows."""
    store = ShardStore(docs.sparkSession, path, target_bytes)
    store.append(docs, arrival(F.col("doc_id")))
    store.compact()
    return store.read(located=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), F.sha1("text").alias("text_sha1"), F.regexp_extract("shard", "([^/]+/[^/]+)/[^/]*$", 1).alias("shard"), "shard_bytes", "shard_rows")
