"""Scans and joins over the catalogues: choice of runs and tomograms, pairing for training, logs, job results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def choose_runs(rows: DataFrame, names: list[str] | None) -> DataFrame:
    """The rows of the named runs; all for None."""
    return rows if names is None else rows.where(F.col("run").isin(names))


def run_or_all(rows: DataFrame, name: str) -> DataFrame:
    """The named run if there is one, else all."""
    found = rows.where(F.col("run") == name).limit(1).count()
    return rows.where(F.col("run") == name) if found else rows


def preferred(tomograms: DataFrame, wanted: str) -> DataFrame:
    """One tomogram for each run: the first whose type contains a text, else the first."""
    best = F.struct((~F.col("tomo_type").contains(wanted)).cast("int"), F.col("ord"))
    return tomograms.groupBy("run").agg(F.min_by(F.struct("ord", "tomo_type", "voxel_spacing"), best).alias("t")).select("run", "t.*")


def nearest_spacing(tomograms: DataFrame, spacing: float) -> DataFrame:
    """The tomograms of each run at the spacing nearest to one, the first of equals."""
    gap = F.struct(F.abs(F.col("voxel_spacing") - spacing), F.col("ord"))
    best = tomograms.groupBy("run").agg(F.min_by("voxel_spacing", gap).alias("voxel_spacing"))
    return tomograms.join(best, ["run", "voxel_spacing"])


def segmentations_by_name(segmentations: DataFrame, spacing: float, names: list[str] | None = None) -> DataFrame:
    """name, run, voxel_spacing: of each name the one of the last run, at that run's spacing nearest to the given one."""
    wanted = segmentations if names is None else segmentations.where(F.col("name").isin(names))
    near = wanted.groupBy("name", "run").agg(F.min_by("voxel_spacing", F.struct(F.abs(F.col("voxel_spacing") - spacing), F.col("voxel_spacing"))).alias("voxel_spacing"))
    return near.groupBy("name").agg(F.max_by(F.struct("run", "voxel_spacing"), "run").alias("s")).select("name", "s.*")


def label_map(targets: DataFrame, *keys: str) -> DataFrame:
    """keys, name, label: background as 0, and the labels of stored target tables (keys, labels: map of name to label)."""
    background = F.map_from_arrays(F.array(F.lit("background")), F.array(F.lit(0)))
    own = F.map_filter("labels", lambda name, _: name != "background")
    return targets.select(*keys, F.explode(F.map_concat(background, own.cast("map<string,int>"))).alias("name", "label"))


def without_named(masks: DataFrame, name: str) -> DataFrame:
    """The masks of other names than one, whatever the case; masks without a name go too."""
    return masks.where(F.lower("name") != name.lower())


def at_spacing(tomograms: DataFrame, spacing: float) -> DataFrame:
    """The first tomogram of each run at exactly a spacing; runs without one are left out."""
    here = tomograms.where(F.col("voxel_spacing") == spacing)
    return here.groupBy("run").agg(F.min_by(F.struct("ord", "tomo_type"), "ord").alias("t")).select("run", "t.*")


def pyramid_level(objects: DataFrame, most: float = 16.0, *keys: str) -> DataFrame:
    """Level 0 for objects up to a radius, level 1 with scale 2 beyond."""
    small = F.col("radius") <= most
    return objects.select(*keys, "object_name", F.when(small, 0).otherwise(1).alias("level"), F.when(small, 1).otherwise(2).alias("scale"))


def arrays_at_level(wanted: DataFrame, volumes: DataFrame, most: float = 16.0) -> DataFrame:
    """For wanted (run, ord, object_name, radius): the level of the pyramid to look for the object in, its scale, and the
    sizes d, h, w of the run's volume there, null where the run has none. volumes: run, d, h, w at level 0."""
    level = pyramid_level(wanted, most, "run", "ord").join(volumes.select("run", "d", "h", "w"), "run", "left")
    return level.withColumns({a: F.floor(F.col(a) / F.col("scale")).cast("int") for a in "dhw"})


def latest(logs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: by lowest priority number, then the newest."""
    order = W.partitionBy(*keys).orderBy("priority", F.desc("ts"), F.desc("log_id"))
    return logs.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def pairs_for_training(tomograms: DataFrame, segmentations: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, split) of runs with both a tomogram and a segmentation, and (run, missing) of the others."""
    t, s = tomograms.select("run").distinct(), segmentations.select("run").distinct()
    held = test.select("run").distinct().withColumn("split", F.lit("test"))
    paired = t.join(s, "run").join(held, "run", "left").select("run", F.coalesce("split", F.lit("train")).alias("split"))
    missing = t.join(s, "run", "left_anti").withColumn("missing", F.lit("segmentation"))
    return paired, missing.unionByName(s.join(t, "run", "left_anti").withColumn("missing", F.lit("tomogram")))


def job_summary(results: DataFrame, shown: int = 5) -> DataFrame:
    """Tasks, successes, their total, and the first errors in order of task with a note of how many more there are."""
    failed = results.where("NOT success")
    first = failed.orderBy("task_id").limit(shown).agg(F.array_sort(F.collect_list(F.struct("task_id", "error"))).alias("e"), F.lit(1).alias("one"))
    all_of = results.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("success").alias("done"), F.round(F.sum(F.when(F.col("success"), F.col("seconds"))), 2).alias("seconds"), F.lit(1).alias("one"))
    more = F.greatest(F.col("tasks") - F.col("done") - shown, F.lit(0))
    return all_of.join(first, "one").select("tasks", "done", "seconds", F.array_join(F.transform("e", lambda x: x["error"]), "; ").alias("errors"), more.alias("more"))


def worker_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("worker").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("seconds"), 2).alias("total"), F.round(F.avg("seconds"), 4).alias("mean"), F.count_if(~F.col("success")).alias("failed"))
