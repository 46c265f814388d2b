"""The data model over the Parquet tables: samples, chunked volumes, voxels, picks and the catalogues.

Volumes have two layouts: chunks, one row with a dense array each, and voxels, one row each. Heavy columns are selected
late, so that plans that need classes or places only do not read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import rng

#: Edge of a sample's and of a chunk's cube, chunks along an edge of a volume, voxel size in angstrom.
SIDE, CHUNKS, SPACING = 4, 2, 10.0
EXTENT = SIDE * CHUNKS
RUNS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, molecule_id (-1 for background), is_background; no voxels are read."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.when(label == 0, -1).otherwise(label).cast("int").alias("molecule_id"), (label == 0).alias("is_background")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, molecule_id and v, the cube's voxels as doubles, z slowest."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.when(label == 0, -1).otherwise(label).cast("int").alias("molecule_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def sample_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", F.posexplode("v").alias("i", "v")).select("sample_id", *coordinates("i", SIDE), "v")


def coordinates(i: str, side: int) -> list:
    at = F.col(i)
    return [F.floor(at / (side * side)).cast("int").alias("z"), (F.floor(at / side) % side).cast("int").alias("y"), (at % side).cast("int").alias("x")]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, cz, cy, cx, v: eight chunks of a volume in a row; incomplete volumes are left out."""
    vec = F.col("vec_id")
    found = table(spark, sf_dir, "embeddings").select(F.floor(vec / 8).cast("long").alias("run"), (vec % 8).cast("int").alias("c"), F.col("embedding").cast("array<double>").alias("v"))
    whole = found.groupBy("run").count().where("count = 8").select("run")
    c = F.col("c")
    return found.join(whole, "run").select("run", F.floor(c / 4).cast("int").alias("cz"), (F.floor(c / 2) % 2).cast("int").alias("cy"), (c % 2).cast("int").alias("cx"), "v")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, z, y, x, v of whole volumes."""
    z, y, x = coordinates("i", SIDE)
    flat = chunks(spark, sf_dir).select("run", "cz", "cy", "cx", F.posexplode("v").alias("i", "v"))
    return flat.select("run", (F.col("cz") * SIDE + z).alias("z"), (F.col("cy") * SIDE + y).alias("y"), (F.col("cx") * SIDE + x).alias("x"), "v")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point annotations in angstrom: run, object_name, from_tool, point_id, x, y, z."""
    event = table(spark, sf_dir, "events").select("event_id", "event_type")
    return event.select(
        (F.col("event_id") % RUNS).alias("run"),
        F.col("event_type").alias("object_name"),
        (F.col("event_type") != "error").alias("from_tool"),
        F.col("event_id").alias("point_id"),
        *[(rng.uniform(f"pick-{a}", "event_id") * (EXTENT * SPACING)).alias(a) for a in "xyz"],
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of pickable objects; not all picked ones are in it."""
    rows = [("click", 1, True, 3.0), ("purchase", 2, True, 6.0), ("view", 3, False, 20.0)]
    return spark.createDataFrame(rows, "object_name string, label int, is_particle boolean, radius double")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of object catalogues, of which several may have one label: ord (place in the catalogue), object_name,
    label, kind, radius."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("object_name"), F.col("p_size").alias("label"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("radius")
    )


def tomograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of tomograms: run, ord, tomo_type, voxel_spacing."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("run"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("tomo_type"), F.col("p_size").cast("double").alias("voxel_spacing")
    )


#: The same views for the comparison queries in SQL.
SQL = {
    "samples": "SELECT vec_id AS sample_id, CASE WHEN label = 0 THEN -1 ELSE label END AS molecule_id, label = 0 AS is_background, embedding::DOUBLE[] AS v FROM embeddings",
    "sample_voxels": "SELECT sample_id, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, v FROM (SELECT vec_id AS sample_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, 64)) AS i FROM embeddings)",
    "voxels": "SELECT run, c // 4 * 4 + i // 16 AS z, c // 2 % 2 * 4 + i // 4 % 4 AS y, c % 2 * 4 + i % 4 AS x, v FROM ("
    "SELECT vec_id // 8 AS run, vec_id % 8 AS c, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, 64)) AS i FROM embeddings "
    "WHERE vec_id // 8 IN (SELECT vec_id // 8 FROM embeddings GROUP BY 1 HAVING count(*) = 8))",
    "picks": "SELECT event_id % 60 AS run, event_type AS object_name, event_type <> 'error' AS from_tool, event_id AS point_id, "
    + ", ".join(f"{rng.uniform_sql(f'pick-{a}', 'event_id')} * 80.0::DOUBLE AS {a}" for a in "xyz")
    + " FROM events",
    "objects": "SELECT * FROM (VALUES ('click', 1, true, 3.0::DOUBLE), ('purchase', 2, true, 6.0::DOUBLE), ('view', 3, false, 20.0::DOUBLE)) t(object_name, label, is_particle, radius)",
    "catalogue": "SELECT p_partkey AS ord, p_name AS object_name, p_size AS label, p_type AS kind, p_size::DOUBLE AS radius FROM part",
    "tomograms": "SELECT p_brand AS run, p_partkey AS ord, p_type AS tomo_type, p_size::DOUBLE AS voxel_spacing FROM part",
}


def with_views(sql: str, *names: str) -> str:
    """A comparison query with the views that it names in front."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {views}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
