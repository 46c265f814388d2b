"""Slabs of segmented bodies: the two surfaces of what has a label, by any of four methods, from volumes in chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import chunks as c
from voxloom.operators import kernels, splicing
from voxloom.sources import storage

#: overlap fits planes to the voxels themselves, the others fit surfaces to the lowest and highest voxel of each column.
METHODS = (*kernels.METHODS, "overlap")


def body(volumes: DataFrame, edge: int, label: int) -> DataFrame:
    """The largest connected part of what has the label, of equal ones the first: chunks of 1 and 0, of runs that have it."""
    same = lambda to: F.transform("v", lambda x: F.when(F.isnan(x), x).otherwise((x == to).cast("double")))
    parts = storage.written(c.components(volumes.withColumn("v", same(F.lit(label))), "run", edge), "parts")
    order = F.struct("area", -F.col("component"))
    best = splicing.component_stats(parts, "run", edge).groupBy("run").agg(F.max_by("component", order).alias("component"))
    return parts.join(best, "run").select("run", "cz", "cy", "cx", same(F.col("component")).alias("v"))


def surface(mask: DataFrame, edge: int, stride: int = 1) -> DataFrame:
    """run, y, x, low, high: the lowest and the highest set voxel of every column, or of every stride-th along both axes.

    Each chunk gives the ends of its own columns, so what is shuffled is no voxels but at most a face for each chunk."""
    def run(batches):
        for batch in batches:
            some = np.nan_to_num(c._cubes(batch.column("v"), edge, edge, edge)) > 0
            row, y, x = np.nonzero(some.any(1))
            at = c._places(batch)[row] * edge
            low, high = some.argmax(1)[row, y, x], edge - 1 - some[:, ::-1].argmax(1)[row, y, x]
            kept = ((at[:, 1] + y) % stride == 0) & ((at[:, 2] + x) % stride == 0)
            numbers = [(at[:, k] + p)[kept].astype(np.int64) for k, p in ((1, y), (2, x), (0, low), (0, high))]
            yield pa.RecordBatch.from_arrays([batch.column("run").take(pa.array(row[kept])), *map(pa.array, numbers)], ["run", "y", "x", "low", "high"])

    kind = mask.schema["run"].dataType.simpleString()
    ends = mask.select("run", "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(run, f"run {kind}, y long, x long, low long, high long")
    return ends.groupBy("run", "y", "x").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _planes(mask: DataFrame, edge: int, rows: int, cols: int, iterations: int, rate: float) -> DataFrame:
    """run, layer, row, col, z of the planes that overlap most, in parts of the volume's height."""
    found = kernels.planes_by_overlap(mask, edge, iterations, rate)
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in ("nz", "ny", "nx")), F.lit(0.0)))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("layer"), F.col(s).alias("offset")) for s in ("top", "bottom")]))
    each = found.select("run", "nz", "ny", "nx", length.alias("length"), sides.alias("s")).select("*", "s.*")
    at = each.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    flat = F.col("nx") * F.col("row") / (rows - 1) + F.col("ny") * F.col("col") / (cols - 1)  # as planes_by_overlap has them
    return at.select("run", "layer", "row", "col", (-(flat + F.col("offset") * F.col("length")) / F.col("nz")).alias("z"))


def slab_of_segmentation(
    volumes: DataFrame, edge: int, spacing: float, label: int, method: str | None = "coupled", rows: int = 50, cols: int = 50, knots: int = 5, stride: int = 1, iterations: int = 20, rate: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """(surfaces, report) of the largest body of a label in each run. volumes: chunks of labels, of runs of any size.

    surfaces: run, layer, row, col, x, y, z in angstrom at rows * cols places over the whole extent. report: run, columns
    (those that the surfaces are fitted to) and error: a run without the label, or with fewer than three columns, has a
    reason and no surfaces; so has one whose columns lie on a line, with the parallel method, but for the reason. Rows and
    columns are two at least. Places and heights are fitted in parts of the run's own extent."""
    method = (method or "coupled").lower()
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, not one of {METHODS}")
    if rows < 2 or cols < 2 or stride < 1:
        raise ValueError("surfaces need two rows and columns, and a stride of one or more")
    sizes = storage.written(c.extents(volumes, "run", edge).select("run", "d", "h", "w"), "sizes")
    mask = storage.written(body(volumes, edge, label), "body")
    ends = storage.written(surface(mask, edge, stride), "surface")
    known = ends.groupBy("run").agg(F.count(F.lit(1)).alias("columns"))
    reason = F.when(F.col("columns").isNull(), "nothing has the label").when(F.col("columns") < 3, "fewer than three columns")
    report = sizes.select("run").join(known, "run", "left").select("run", F.coalesce("columns", F.lit(0)).alias("columns"), reason.alias("error"))
    enough = known.where("columns >= 3").select("run")
    if method == "overlap":
        found = _planes(mask.join(enough, "run"), edge, rows, cols, iterations, rate)
    else:
        placed = ends.join(enough, "run").join(sizes, "run").select("run", (F.col("x") / F.col("w")).alias("x"), (F.col("y") / F.col("h")).alias("y"), "low", "high", "d")
        sides = F.explode(F.array(*[F.struct(F.lit(layer).alias("layer"), F.col(end).alias("end")) for layer, end in (("top", "high"), ("bottom", "low"))]))
        points = placed.select("run", "x", "y", "d", sides.alias("s")).select("run", "s.layer", "x", "y", (F.col("s.end") / F.col("d")).alias("z"))
        found = kernels.slab(points, method, 1.0, 1.0, rows, cols, knots)
    place = [(F.col("col") / (cols - 1) * F.col("w") * spacing).alias("x"), (F.col("row") / (rows - 1) * F.col("h") * spacing).alias("y")]
    return found.join(sizes, "run").select("run", "layer", "row", "col", *place, (F.col("z") * F.col("d") * spacing).alias("z")), report
