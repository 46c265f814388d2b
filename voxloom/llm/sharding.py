"""Sharding by size-tiered compaction: small immutable shards in, files of a target size out, behind a versioned manifest.

Arrivals are written as they are partitioned, without a shuffle. Shards of about the same size (a factor of four) make
a tier; a tier of several shards is packed, in order, into groups of the target size, and each group is rewritten as one
file by one task that streams it. What is merged grows in tiers, so a row is rewritten a logarithmic number of times.

A manifest is a table of all live shards with their rows and bytes. A version is one small file that names its manifest,
written beside its place and put there by an operation that never replaces a file: a hard link in a mounted folder, a
rename that refuses an existing target elsewhere, as in HDFS. So one of several writers of a version gets it, the others
get a Conflict, and readers see a version whole or not at all; they go by the highest. A store whose renames copy, as
object stores' do, needs a conditional put instead. Appends that meet a conflict are put on top of the version that won.

Shards are never changed; those that no version needs can be removed by vacuum(). Rows and columns pass through as they
are, nulls, repeats and any further columns included; an empty arrival adds a version without rows. Merges are planned in
a table, of which the driver gets the files of one job at a time; a reader gets the paths it is to read.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import common

TARGET_BYTES, FAN_IN, TIER_FACTOR, LEAST_BYTES = 128 << 20, 4, 4, 1 << 20
#: Files that one job writes at most, which bounds the size of its plan.
GROUPS_A_JOB = 200
#: A table of shards is broadcast up to so many rows of about 100 bytes. Of more, a join by shard is spread well enough.
MOST_BROADCAST = 50_000
#: How often an append is tried against other writers.
TRIES = 20
MANIFEST = "shard string, arrival string, rows long, bytes long"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest version, 0 for a table that has none."""
        folder = self._path(f"{self.path}/manifest")
        if not self.fs.exists(folder):
            return 0
        return max([int(x.getPath().getName()[1:]) for x in self.fs.listStatus(folder) if x.getPath().getName().startswith("v")], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        named = self.fs.open(self._path(f"{self.path}/manifest/v{version:08d}"))
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/lists/{named.readUTF()}")
        finally:
            named.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard they are in as _shard."""
        files = [f"{self.path}/data/{x.shard}" for x in self.manifest(version).select("shard").toLocalIterator()]
        if not files:  # the columns are known all the same if anything ever arrived
            runs = self.fs.listStatus(self._path(f"{self.path}/data")) if self.fs.exists(self._path(f"{self.path}/data")) else []
            if not len(runs):
                raise ValueError("nothing has arrived at the table")
            return self.spark.read.parquet(str(runs[0].getPath())).limit(0).withColumn("_shard", F.lit(""))
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
        return self.spark.read.parquet(*files).withColumn("_shard", name)

    def _shards(self, run: str, arrival: str) -> DataFrame:
        """What a finished write has left, one row for each file with rows in it."""
        files = self.spark.read.parquet(f"{self.path}/data/{run}").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b"))
        name = F.element_at(F.split("p", "/data/"), -1)
        return files.groupBy("p", "b").agg(F.count(F.lit(1)).alias("rows")).select(name.alias("shard"), F.lit(arrival).alias("arrival"), "rows", F.col("b").alias("bytes"))

    def _put(self, staged: str, place: str) -> bool:
        """Move a file to a place where there is none; False if there is one. Never replaces."""
        if self._path(self.path).toUri().getScheme() in (None, "file"):
            local = [self._path(x).toUri().getPath() for x in (staged, place)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            os.remove(local[0])
            return True
        jvm = self.spark._jvm.org.apache.hadoop.fs
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.Options, "Rename"), 1)
        never[0] = getattr(jvm.Options, "Rename").NONE
        try:
            jvm.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(staged), self._path(place), never)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def _commit(self, shards: DataFrame, after: int) -> int:
        name = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.path}/lists/{name}")
        staged, place = f"{self.path}/staged/{name}", f"{self.path}/manifest/v{after + 1:08d}"
        self.fs.mkdirs(self._path(f"{self.path}/manifest"))
        out = self.fs.create(self._path(staged), False)
        out.writeUTF(name)
        out.close()
        if not self._put(staged, place):
            raise Conflict(f"version {after + 1} exists")
        return after + 1

    def append(self, rows: DataFrame, arrival: str) -> int:
        """Add rows as new shards, one for each of their partitions that has any, to whatever version is the highest then."""
        run = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/data/{run}")
        for left in reversed(range(TRIES)):
            after = self.version()
            try:
                return self._commit(self.manifest(after).unionByName(self._shards(run, arrival)), after)
            except Conflict:
                if not left:
                    raise

    def plan(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
        """The shards to merge: shard, group. A group is of one tier, of about the target size, and has several shards."""
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(LEAST_BYTES)) / LEAST_BYTES) / F.log(F.lit(float(TIER_FACTOR)))).cast("int")
        small = self.manifest().where(F.col("bytes") < target // 2).withColumn("tier", tier)
        in_tier = W.partitionBy("tier")
        placed = (
            small.withColumn("n", F.count(F.lit(1)).over(in_tier))
            .where(F.col("n") >= fan_in)
            .withColumn("before", F.coalesce(F.sum("bytes").over(in_tier.orderBy("arrival", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("group", F.concat_ws("-", F.col("tier"), F.floor(F.col("before") / target)))
        )
        return placed.withColumn("in_group", F.count(F.lit(1)).over(W.partitionBy("group"))).where("in_group > 1").select("shard", "group")

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """One round of merges, committed as one version; the version as it was if there is nothing to merge.

        The merges are void, with a Conflict, if another writer commits first."""
        after = self.version()
        numbered = W.orderBy("group")  # of groups, each the size of a target file
        groups = self.plan(target, fan_in).groupBy("group").agg(F.collect_list("shard").alias("shards")).withColumn("n", F.row_number().over(numbered) - 1)
        todo = common.written(groups, "merges")
        count, written = todo.count(), []
        if not count:
            return after
        for i in range(0, count, GROUPS_A_JOB):
            run = uuid.uuid4().hex
            here = todo.where(F.col("n").between(i, i + GROUPS_A_JOB - 1)).orderBy("n").collect()
            parts = [self.spark.read.parquet(*[f"{self.path}/data/{s}" for s in sorted(x.shards)]).coalesce(1) for x in here]
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.option("compression", "zstd").parquet(f"{self.path}/data/{run}")
            written.append(self._shards(run, "merged"))
        kept = self.manifest(after).join(todo.select(F.explode("shards").alias("shard")), "shard", "left_anti").select("shard", "arrival", "rows", "bytes")
        return self._commit(reduce(DataFrame.unionByName, written, kept), after)

    def settle(self, **options) -> int:
        """Compact until nothing is left to merge."""
        at = -1
        while at != (at := self.compact(**options)):
            pass
        return at

    def vacuum(self) -> None:
        """Remove the shards that the latest version doesn't list, and older versions. No writer may be at work.

        Runs without live shards go as a whole; of others the live files' names reach the driver, run by run. A table
        without rows keeps its empty files, which have its columns."""
        at = self.version()
        live = self.manifest(at).withColumn("run", F.substring_index("shard", "/", 1))
        counts = {x.run: x["count"] for x in live.groupBy("run").count().toLocalIterator()}
        for run in self.fs.listStatus(self._path(f"{self.path}/data")) if counts else ():
            name = run.getPath().getName()
            if name not in counts:
                self.fs.delete(run.getPath(), True)
                continue
            files = [f for f in self.fs.listStatus(run.getPath()) if f.getPath().getName().startswith("part-")]
            if len(files) > counts[name]:
                needed = {x.shard for x in live.where(F.col("run") == name).select("shard").toLocalIterator()}
                for f in files:
                    if f"{name}/{f.getPath().getName()}" not in needed:
                        self.fs.delete(f.getPath(), False)
        for v in self.fs.listStatus(self._path(f"{self.path}/manifest")):
            if v.getPath().getName() != f"v{at:08d}":
                self.fs.delete(v.getPath(), True)


def op4_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """All documents arrive in batches, are compacted, and read back from the shards that the latest version lists.

    doc_id, text_sha256, table_rows (rows that the manifest lists), within_target (the row's shard is of 1.5 times the
    target size at most), mergeable (the row's shard would be merged by a further round)."""
    docs = common.documents(spark, sf_dir)
    table = ShardedTable(spark, f"{common.shared_folder(spark)}/voxloom/sharded-{uuid.uuid4().hex}")
    for i in range(arrivals):
        table.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i), f"arrival-{i}")
    table.settle()
    table.vacuum()
    shards = table.manifest().join(table.plan().select("shard", F.lit(True).alias("planned")), "shard", "left")
    shards = shards.select(
        F.col("shard").alias("_shard"),
        F.sum("rows").over(W.partitionBy()).cast("long").alias("table_rows"),  # one row for each shard
        (F.col("bytes") <= 1.5 * TARGET_BYTES).alias("within_target"),
        F.coalesce("planned", F.lit(False)).alias("mergeable"),
    )
    if table.manifest().count() <= MOST_BROADCAST:
        shards = F.broadcast(shards)
    hashed = table.read().select("doc_id", "_shard", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return hashed.join(shards, "_shard").select("doc_id", "text_sha256", "table_rows", "within_target", "mergeable")


#: Every text comes back once and unchanged, the manifest counts all rows, and nothing is left to merge.
ORACLE_SQL = """
SELECT doc_id, sha256(text) AS text_sha256, count(*) OVER () AS table_rows, TRUE AS within_target, FALSE AS mergeable FROM documents
"""
