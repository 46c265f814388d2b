"""Surfaces, components and fits over voxel rows and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def surface_points(mask: DataFrame, spacing: float, stride: int = 1) -> DataFrame:
    """The lowest and highest set voxel of each column, in angstrom: run, y, x, bottom, top."""
    some = mask.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)) if stride > 1 else mask
    return some.groupBy("run", "y", "x").agg((F.min("z") * spacing).alias("bottom"), (F.max("z") * spacing).alias("top"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """run, component, area, centroid; and whether it is the run's largest, the lowest number of equals."""
    stats = labelled.groupBy("run", "component").agg(F.count(F.lit(1)).alias("area"), *[F.round(F.avg(a), 6).alias(f"c{a}") for a in "zyx"])
    best = W.partitionBy("run").orderBy(F.desc("area"), "component")
    return stats.withColumn("largest", F.row_number().over(best) == 1)


def centroid_boxes(stats: DataFrame, box: int, side: int) -> DataFrame:
    """A box of full size around each centroid, shifted back inside; none if the volume is smaller than the box."""
    low = lambda a: F.least(F.greatest(F.lit(0), (F.col(f"c{a}") - box // 2).cast("int")), F.lit(side - box))
    return stats.where(F.lit(side >= box)).select("run", "component", *[low(a).alias(f"{a}_lo") for a in "zyx"], *[(low(a) + box).alias(f"{a}_hi") for a in "zyx"])


def soft_iou(pairs: DataFrame) -> DataFrame:
    """sum(p * q) / (sum(p) + sum(q) - sum(p * q)) by run."""
    both = F.sum(F.col("p") * F.col("q"))
    return pairs.groupBy("run").agg(F.round(both / (F.sum("p") + F.sum("q") - both), 6).alias("iou"))


def residuals(fitted: DataFrame, *keys: str) -> DataFrame:
    square = F.sum((F.col("pred") - F.col("z")) * (F.col("pred") - F.col("z")))
    return fitted.groupBy(*keys).agg(F.round(F.sqrt(square), 5).alias("norm"), F.round(F.sqrt(square / F.count(F.lit(1))), 5).alias("rms"))


def bending_energy(grid: DataFrame, *key: str) -> DataFrame:
    """Mean squared second difference along the rows plus that along the columns; 0 for an axis under three knots."""
    def along(axis: str, other: str) -> DataFrame:
        w = W.partitionBy(*key, other).orderBy(axis)
        second = F.lead("v", 2).over(w) - 2 * F.lead("v", 1).over(w) + F.col("v")
        return grid.withColumn("d", second).groupBy(*key).agg(F.coalesce(F.avg(F.col("d") * F.col("d")), F.lit(0.0)).alias(axis))

    return along("row", "col").join(along("col", "row"), list(key)).select(*key, F.round(F.col("row") + F.col("col"), 5).alias("energy"))


def plane_fit(points: DataFrame, *key: str) -> DataFrame:
    """Least squares z = a*x + b*y + c by key (run), from sums: key, a, b, c. Fewer than three points or collinear ones: none."""
    key = key or ("run",)
    s = points.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("det", det).where("n >= 3 AND abs(det) > 1e-9")
    s = s.withColumn("a", (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.col("det")).withColumn("b", (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.col("det"))
    return s.select(*key, "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def parallel_planes(points: DataFrame) -> DataFrame:
    """Two layers with one slope: run, a, b, top, bottom. Deviations from the layers' means give the slope, the means the
    offsets. A run needs three points in each layer."""
    layer = points.groupBy("run", "layer").agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(f"m{k}") for k in "xyz"])
    enough = layer.where("n >= 3").groupBy("run").agg(F.count(F.lit(1)).alias("layers")).where("layers = 2").select("run")
    centred = points.join(layer, ["run", "layer"]).join(enough, "run").select("run", *[(F.col(k) - F.col(f"m{k}")).alias(k) for k in "xyz"])
    slope = plane_fit(centred).select("run", "a", "b")
    offset = layer.join(slope, "run").withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my"))
    return offset.groupBy("run", "a", "b").agg(F.max(F.when(F.col("layer") == "top", F.col("c"))).alias("top"), F.max(F.when(F.col("layer") == "bottom", F.col("c"))).alias("bottom"))


def lattice(planes: DataFrame, rows: int, cols: int, width: float, height: float) -> DataFrame:
    """Each plane at rows*cols places: run, row, col, x, y, z; columns run fastest."""
    at = planes.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    at = at.withColumn("x", F.col("col") * width / (cols - 1)).withColumn("y", F.col("row") * height / (rows - 1))
    return at.withColumn("z", F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")).select("run", "row", "col", "x", "y", "z")


def mesh(runs: DataFrame, rows: int, cols: int) -> DataFrame:
    """Faces (run, part, a, b, c) of the closed box between two lattices; vertices are numbered row by row, top first."""
    n = rows * cols
    cell = runs.select("run").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 2)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cols - 2))))
    p = F.col("r") * cols + F.col("k")
    sheets = cell.select("run", F.explode(F.array(*[F.struct(F.lit(name).alias("part"), (p + x).alias("a"), (p + y).alias("b"), (p + z).alias("c")) for name, x, y, z in (
        ("top", 0, 1, cols), ("top", 1, cols + 1, cols), ("bottom", n, n + cols, n + 1), ("bottom", n + 1, n + cols, n + cols + 1))])).alias("f"))
    edge = [(r * cols, (r + 1) * cols) for r in range(rows - 1)] + [((r + 1) * cols + cols - 1, r * cols + cols - 1) for r in range(rows - 1)]
    edge += [(k + 1, k) for k in range(cols - 1)] + [((rows - 1) * cols + k, (rows - 1) * cols + k + 1) for k in range(cols - 1)]
    walls = [F.struct(F.lit("wall").alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, j in edge for a, b, c in ((i, j, n + i), (j, n + j, n + i))]
    sides = runs.select("run", F.explode(F.array(*walls)).alias("f"))
    return sheets.select("run", "f.*").unionByName(sides.select("run", "f.*"))
