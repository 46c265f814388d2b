"""Spliced sub-volumes: a component cut out of one volume, blended into a random crop of another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import rng
from voxloom.operators import chunks as c
from voxloom.operators.volume import kernel

#: Boxes that a chunk is sent with at once, about; steps by which a mask grows.
AT_ONCE, GROWN = 256, 2
PART = ("z", "y", "x", "d", "h", "w")


def component_stats(labels: DataFrame, key: str, edge: int) -> DataFrame:
    """key, component, area and centroid cz, cy, cx of chunks of component numbers; sums by chunk, no voxel rows."""
    def run(batches):
        for batch in batches:
            cubes = np.nan_to_num(c._cubes(batch.column("v"), edge, edge, edge))
            row, *at = np.nonzero(cubes > 0)
            z, y, x = (a + p * edge for a, p in zip(at, c._places(batch)[row].T, strict=True))
            found, which = np.unique(np.stack([row, cubes[row, at[0], at[1], at[2]].astype(np.int64)], 1), axis=0, return_inverse=True)
            sums = [np.bincount(which.reshape(-1), w, minlength=len(found)).astype(np.int64) for w in (None, z, y, x)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(found[:, 0])), pa.array(found[:, 1]), *map(pa.array, sums)], [key, "component", "n", "z", "y", "x"])

    kind = labels.schema[key].dataType.simpleString()
    parts = labels.select(key, "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(run, f"{key} {kind}, component long, n long, z long, y long, x long")
    centre = [F.round(F.sum(a) / F.sum("n"), 6).alias(f"c{a}") for a in "zyx"]
    return parts.groupBy(key, "component").agg(F.sum("n").alias("area"), *centre)


def cut_boxes(boxes: DataFrame, chunks: DataFrame, key: str, edge: int) -> DataFrame:
    """id and part, a struct of place in the box (z, y, x), size (d, h, w) and voxels v, for each box and chunk that meet.

    boxes: id, key, z, y, x, d, h, w, which may reach beyond the volume. The boxes of a chunk are sent to it together, in
    lists of a bounded size, so a chunk's array goes on once for each list and not for each box."""
    spans = boxes.select("id", key, *PART)
    for a, n in zip("zyx", "dhw", strict=True):
        spans = spans.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(a) / edge).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / edge).cast("int"))))
    place = [key, "cz", "cy", "cx"]
    many = F.ceil(F.count(F.lit(1)).over(W.partitionBy(*place)) / AT_ONCE)
    dealt = spans.withColumn("_list", F.pmod(F.xxhash64("id"), many))
    wanted = dealt.groupBy(*place, "_list").agg(F.collect_list(F.struct("id", *PART)).alias("wanted"))
    met = chunks.select(*place, F.col("v").cast("array<double>")).join(wanted.drop("_list"), place)
    kind = boxes.schema["id"].dataType.simpleString()

    def take(batches):
        for batch in batches:
            cubes, at = c._cubes(batch.column("v"), edge, edge, edge), c._places(batch) * edge
            lists = batch.column("wanted")
            items = dict(zip(["id", *PART], lists.flatten().flatten(), strict=True))
            row = np.repeat(np.arange(len(cubes)), np.asarray(lists.value_lengths()))
            low, size = (np.stack([np.asarray(items[x], dtype=np.int64) for x in names], 1) for names in ("zyx", "dhw"))
            first, end = np.maximum(low, at[row]), np.minimum(low + size, at[row] + edge)
            cut = [cubes[i][tuple(slice(a, b) for a, b in zip(f, e, strict=True))] for i, f, e in zip(row, first - at[row], end - at[row], strict=True)]
            numbers = [pa.array(x.astype(np.int32)) for x in [*(first - low).T, *(end - first).T]]
            part = pa.StructArray.from_arrays([*numbers, c._ragged(cut)], [*PART, "v"])
            yield pa.RecordBatch.from_arrays([items["id"], part], ["id", "part"])

    return met.mapInArrow(take, f"id {kind}, part struct<{', '.join(f'{n}: int' for n in PART)}, v: array<double>>")


def filled(parts, shape: tuple[int, int, int]) -> np.ndarray:
    """A box from (z, y, x, d, h, w, v), NaN where no part is."""
    out = np.full(shape, np.nan)
    for z, y, x, d, h, w, v in parts:
        out[z : z + d, y : y + h, x : x + w] = v.reshape(d, h, w)
    return out


def grown(mask: np.ndarray, there: np.ndarray, steps: int = GROWN) -> np.ndarray:
    """What is set, and what is next to it by a face, again and again, within `there`."""
    for _ in range(steps):
        out = mask.copy()
        for axis in range(3):
            low, high = (tuple(s if k == axis else slice(None) for k in range(3)) for s in (slice(None, -1), slice(1, None)))
            out[low] |= mask[high]
            out[high] |= mask[low]
        mask = out & there
    return mask


def blend(synthetic: np.ndarray, mask: np.ndarray, real: np.ndarray, sigma: float) -> np.ndarray:
    """The synthetic cube where the mask is set, the real one elsewhere; the mask's edge is smoothed by a Gaussian."""
    if not sigma:
        return np.where(mask, synthetic, real)
    n = len(mask)
    g = np.zeros((n, n))
    for to, at, w in kernel(n, sigma):
        g[to, at] = w
    weight = np.clip(np.einsum("az,by,cx,zyx->abc", g, g, g, mask.astype(float), optimize=True), 0, 1)
    return synthetic * weight + real * (1 - weight)


def corner(size: Column, box: int, seed: str) -> Column:
    return F.floor(rng.uniform(seed, "id") * (size - box + 1)).cast("int")


def random_crops(wanted: DataFrame, volumes: DataFrame, sizes: DataFrame, edge: int, box: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """A random crop for each (id, run) of wanted, as (parts, whole): parts are from cut_boxes(); volumes that are no larger
    than the box along some axis are resized to it as a whole instead, (id, v)."""
    sized = wanted.select("id", "run").join(sizes.select("run", "d", "h", "w"), "run")
    small = F.least("d", "h", "w") <= box
    at = [corner(F.col(n), box, f"{seed}-{a}").alias(a) for a, n in zip("zyx", "dhw", strict=True)]
    cut = cut_boxes(sized.where(~small).select("id", "run", *at, *[F.lit(box).alias(n) for n in "dhw"]), volumes, "run", edge)
    of_small = sized.where(small).select("id", "run")
    resized = c.resized(volumes.join(of_small.select("run"), "run", "left_semi"), "run", edge, box)
    cubes = resized.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("z", "y", "x", "v"))).alias("v"))
    return cut, of_small.join(cubes.select("run", F.col("v.v").alias("v")), "run").select("id", "v")


def cropped(wanted: DataFrame, volumes: DataFrame, edge: int, box: int, seed: str = "crop") -> DataFrame:
    """id and v, a random cube of box voxels a side for each (id, run) of wanted, cut out of the run's chunks. A volume that
    is no larger than the box along some axis is resized to it as a whole. Runs with missing voxels, or none, have no crop.
    Ids are unique; the place is a function of the seed and the id."""
    crops, whole = random_crops(wanted, volumes, c.extents(volumes, "run", edge).where("whole"), edge, box, seed)

    def together(batches):
        for batch in batches:
            lists = batch.column("parts")
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            fields = dict(zip([*PART, "v"], lists.flatten().flatten(), strict=True))
            numbers = [np.asarray(fields[n]).tolist() for n in PART]
            cut = np.concatenate([[0], np.cumsum(np.asarray(fields["v"].value_lengths()))])
            values = np.asarray(fields["v"].flatten(), dtype=float)
            cubes = [filled(([*[x[i] for x in numbers], values[cut[i] : cut[i + 1]]] for i in range(a, b)), (box,) * 3) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), c._ragged(cubes)], ["id", "v"])

    kind = wanted.schema["id"].dataType.simpleString()
    fields = [F.col(f"part.{n}").alias(n) for n in (*PART, "v")]
    held = crops.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    return held.mapInArrow(together, f"id {kind}, v array<double>").unionByName(whole)


def spliced_samples(draws: DataFrame, stats: DataFrame, labels: DataFrame, synthetic: DataFrame, real: DataFrame, edge: int, box: int, sigma: float, seed: str = "splice") -> DataFrame:
    """draw, kind, component_run, component, run and v, a cube of box voxels a side.

    draws come from dataset.spliced_set(); stats are the components' centroids, labels their numbers by chunk, synthetic the
    voxels they are cut from and real those of the targets, all chunks by run. A component's box lies around its centroid,
    moved inside its volume; draws of components in volumes that are smaller than the box are dropped. The mask is the
    component grown by GROWN voxels. Background draws are crops of the target and no more.

    What a draw needs is cut out of the chunks of three tables and brought together by draw: its mask with a margin, its
    voxels, its target."""
    draws = draws.withColumn("id", F.col("draw"))
    sizes = c.extents(synthetic, "run", edge).where("whole")
    own = draws.where("kind = 'spliced'").join(stats.select(F.col("run").alias("component_run"), "component", "cz", "cy", "cx"), ["component_run", "component"])
    own = own.join(sizes.select(F.col("run").alias("component_run"), "d", "h", "w"), "component_run").where(F.least("d", "h", "w") >= box)
    low = [F.least(F.greatest(F.lit(0), (F.col(f"c{a}") - box // 2).cast("int")), F.col(n) - box).cast("int").alias(a) for a, n in zip("zyx", "dhw", strict=True)]
    boxes = own.select("id", F.col("component_run").alias("run"), *low, *[F.lit(box).alias(n) for n in "dhw"])
    wide = boxes.select("id", "run", *[(F.col(a) - GROWN).alias(a) for a in "zyx"], *[(F.col(n) + 2 * GROWN).alias(n) for n in "dhw"])
    kept = draws.where("kind = 'background'").select("id", "run").unionByName(own.select("id", "run"))
    crops, whole = random_crops(kept, real, c.extents(real, "run", edge).where("whole"), edge, box, f"{seed}-crop")
    as_part = F.struct(*[F.lit(0).alias(a) for a in "zyx"], *[F.lit(box).alias(n) for n in "dhw"], "v").alias("part")
    sources = [cut_boxes(wide, labels, "run", edge), cut_boxes(boxes, synthetic, "run", edge), crops.unionByName(whole.select("id", as_part))]
    parts = None
    for i, s in enumerate(sources):
        s = s.select("id", F.struct(F.lit(i).alias("source"), "part.*").alias("p"))
        parts = s if parts is None else parts.unionByName(s)
    held = parts.groupBy("id").agg(F.collect_list("p").alias("parts")).join(draws, "id")
    names, kinds = ["draw", "kind", "component_run", "component", "run"], "draw long, kind string, component_run long, component long, run long, v array<double>"

    def together(batches):
        for batch in batches:
            lists, out = batch.column("parts"), []
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            fields = dict(zip(["source", *PART, "v"], lists.flatten().flatten(), strict=True))
            source, *numbers = (np.asarray(fields[n]).tolist() for n in ("source", *PART))
            cut = np.concatenate([[0], np.cumsum(np.asarray(fields["v"].value_lengths()))])
            values = np.asarray(fields["v"].flatten(), dtype=float)
            for k, component in enumerate(batch.column("component").to_pylist()):
                mine = range(ends[k], ends[k + 1])
                take = lambda s, n, mine=mine: filled(([*[x[i] for x in numbers], values[cut[i] : cut[i + 1]]] for i in mine if source[i] == s), (n, n, n))
                cube = take(2, box)
                if component is not None:
                    labelled = take(0, box + 2 * GROWN)
                    mask = grown(labelled == component, ~np.isnan(labelled))[(slice(GROWN, -GROWN),) * 3]
                    cube = blend(take(1, box), mask, cube, sigma)
                out.append(cube)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], c._ragged(out)], [*names, "v"])

    return held.select(*names, "parts").mapInArrow(together, kinds)
