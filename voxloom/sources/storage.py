"""Reading and writing: project files, volume files, the sample cache, logs."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a
    temporary one, which other machines would not see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder, so what comes after depends on no earlier plan; see removed()."""
    path = f"{shared_folder(df.sparkSession)}/voxloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def held(df: DataFrame):
    """The rows, kept by the executors (memory first, then their disks) from their first use to the end of the block, so
    that further uses scan nothing. What a lost executor kept is computed again."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


#: Below a path that commit() writes to: an empty file for each version, named by its number and folder.
VERSIONS = "_versions"


def _files(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of the versions that were committed, the newest last."""
    files, place = _files(spark, f"{path}/{VERSIONS}")
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def commit(path: str, tables: dict[str, DataFrame], keep: int = 2) -> str:
    """Write the tables as one version of what is stored at a path, and return the version's folder.

    All tables are written to a folder of their own, then an empty file that names it is put, which needs no rename. A
    reader sees all of a version or the one before, also if a write fails or the job is killed. Of writers at the same time,
    the one with the later name wins. Versions before the last `keep` are removed, so a reader has until the next commit but
    one; what a failed run left has no name and is not read. Versions are few: they are listed by the driver."""
    spark = next(iter(tables.values())).sparkSession
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    before = versions(spark, path)
    number = int(before[-1].split("-")[0]) + 1 if before else 0
    files, place = _files(spark, f"{path}/{VERSIONS}/{number:09d}-{folder}")
    files.create(place, False).close()
    for old in versions(spark, path)[:-keep]:
        for gone in (f"{path}/{VERSIONS}/{old}", f"{path}/{old.split('-')[1]}"):
            files, place = _files(spark, gone)
            files.delete(place, True)
    return f"{path}/{folder}"


def latest(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest version at a path; None where there is none."""
    found = versions(spark, path)
    return f"{path}/{found[-1].split('-')[1]}" if found else None


def project(spark: SparkSession, path: str) -> DataFrame:
    """The pickable objects of a project file: name, label, is_particle, radius, and what else they have."""
    return spark.read.json(path, multiLine=True).select(F.explode("pickable_objects").alias("o")).select("o.*")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """run, shape, v of all .npy files below a path, which any store that Spark reads may hold; run is the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)

    def decode(batches):
        for pdf in batches:
            arrays = [np.load(io.BytesIO(c)) for c in pdf["content"]]
            yield pd.DataFrame({"run": pdf["run"], "shape": [list(a.shape) for a in arrays], "v": [a.ravel().astype(float) for a in arrays]})

    name = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    return files.select(name.alias("run"), "content").mapInPandas(decode, "run string, shape array<int>, v array<double>")


def write_volumes(volumes: DataFrame, path: str) -> None:
    """One folder for each type and spacing, so that a reader of one lists no others."""
    volumes.write.partitionBy("tomo_type", "voxel_spacing").mode("append").parquet(path)


def write_cache(samples: DataFrame, path: str) -> None:
    """The sample cache, which replaces the one before as a whole; an empty set of samples is not written."""
    if samples.limit(1).count():
        commit(path, {"samples": samples})


def cache_folder(spark: SparkSession, path: str) -> str | None:
    """Where the cache's files are: in its newest version, or, in older caches, in the folder itself. None without a cache,
    or with one that was never finished."""
    found = latest(spark, path)
    if found:
        return f"{found}/samples"
    files, place = _files(spark, path)
    plain = files.exists(place) and any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(place))
    return path if plain else None


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached samples. Older caches lack is_background, which is then false, or key, which is then the class."""
    df = spark.read.parquet(cache_folder(spark, path) or path)
    if "is_background" not in df.columns:
        df = df.withColumn("is_background", F.lit(False))
    return df if "key" in df.columns else df.withColumn("key", F.col("molecule_id").cast("string"))


def cached(spark: SparkSession, path: str | None, build, most: int | None = None) -> DataFrame:
    """The cache if there is one, else build() and its cache; no cache for path None. Then at most so many rows."""
    if path is None:
        df = build()
    else:
        if not cache_folder(spark, path):
            built = build()
            write_cache(built, path)
            if not cache_folder(spark, path):
                return built
        df = read_cache(spark, path)
    return df if most is None else df.orderBy("sample_id").limit(most)


def log_job(spark: SparkSession, path: str, tool: str, inputs: dict, parameters: dict, output: dict) -> None:
    """Append a job's inputs, parameters and output to a log table."""
    row = [(tool, json.dumps(inputs), json.dumps(parameters), json.dumps(output))]
    spark.createDataFrame(row, "tool string, input string, parameters string, output string").withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def volume_arrays(found: DataFrame, names: list[str]) -> DataFrame:
    """run and v from a table with one column for each array of a group: the first of the named ones that a run has.

    An error for a run that has none of them."""
    known = [F.col(n) for n in names if n in found.columns]
    nothing = F.raise_error(F.concat(F.lit(f"none of {names} in "), F.col("run").cast("string")))
    return found.select("run", F.coalesce(*known, nothing).alias("v"))


def the_only(rows: DataFrame, what: str) -> DataFrame:
    """The rows of a lookup, or an error when it finds none."""
    if not rows.limit(1).count():
        raise LookupError(f"no {what}")
    return rows


def save_dataset(samples: DataFrame, volumes: DataFrame, metadata: dict, path: str) -> None:
    """A dataset for later: its metadata, its samples (places, or the cubes as well) and the sizes of its volumes, which
    replace a dataset that was there as one."""
    about = samples.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1)
    commit(path, {"metadata": about, "samples": samples, "volumes": volumes.select("run", "d", "h", "w")})


def load_dataset(spark: SparkSession, path: str, volumes: DataFrame) -> tuple[DataFrame, dict]:
    """The samples of a saved dataset, each bound to the first of the given volumes (run, d, h, w) that has the size of its
    own one; samples of volumes without such a match are left out."""
    found = latest(spark, path)
    if not found:
        raise LookupError(f"no dataset at {path}")
    metadata = json.loads(spark.read.parquet(f"{found}/metadata").first()[0])
    samples = spark.read.parquet(f"{found}/samples").join(bound(spark.read.parquet(f"{found}/volumes"), volumes), "run")
    return samples.withColumn("run", F.col("bound")).drop("bound"), metadata


def bound(saved: DataFrame, volumes: DataFrame) -> DataFrame:
    """run, bound: for each saved volume (run, d, h, w) the first of the given ones of its size; none where there is none."""
    of_size = volumes.groupBy("d", "h", "w").agg(F.min("run").alias("bound"))
    return saved.join(of_size, ["d", "h", "w"]).select("run", "bound")


#: What tells point sets, and segmentations, of a run apart.
SET_KEYS = ["run", "object_name", "user_id", "session_id"]


def write_sets(rows: DataFrame, path: str) -> None:
    """Point sets or segmentations by run, name, user and session: a set that exists is replaced, others stay as they are."""
    rows.write.partitionBy(*SET_KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_sets(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """The sets with the given keys; other folders aren't listed."""
    found = spark.read.option("recursiveFileLookup", "false").parquet(path)
    for k, v in keys.items():
        found = found.where(F.col(k) == v)
    return found


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> DataFrame:
    """Both tables of the meshes as one version, and how many vertices and faces each run has, from what was written."""
    folder, spark = commit(path, {"vertices": vertices, "faces": faces}), vertices.sparkSession
    count = lambda name: spark.read.parquet(f"{folder}/{name}").groupBy("run").agg(F.count(F.lit(1)).alias(name))
    return count("vertices").join(count("faces"), "run", "full")
