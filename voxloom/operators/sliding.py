"""Inference on whole volumes by a sliding window: tiles with overlap, mirrored copies, Gaussian weights, sums by chunk."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import chunks as c
from voxloom.operators.splicing import PART, cut_boxes, filled
from voxloom.sources import storage

Predictor = Callable[[np.ndarray], np.ndarray]
#: Cubes that a predictor is given at once.
AT_ONCE = 32
#: What workers have made, by the job; a worker keeps it for its later tasks.
_made: dict[str, Predictor] = {}


def starts(n: int, window: int, overlap: float, in_front: bool = False) -> list[int]:
    """Where windows start along an axis of n voxels: at equal steps, the last one moved back to end with the axis. An axis
    that is shorter than the window lies in the middle of one, or at its end if all padding is to be in front."""
    if n <= window:
        return [n - window if in_front else -((window - n) // 2)]
    step = max(1, int(window * (1 - overlap)))
    return sorted({min(s, n - window) for s in range(0, n - window + step, step)})


def importance(window: int) -> np.ndarray:
    """The weight of each place in a window: a Gaussian of an eighth of the window, at least a thousandth."""
    x = np.exp(-((np.arange(window) - (window - 1) / 2) ** 2) / (2 * (0.125 * window) ** 2))
    w = x[:, None, None] * x[:, None] * x
    return np.maximum(w, max(w.min(), 1e-3))


def tiles(sizes: DataFrame, key: str, window: int, overlap: float, mirrors: int, in_front: bool = False) -> DataFrame:
    """id (key, z, y, x, mirrors, apart) of the windows of each volume (key, d, h, w).

    Copy m of a volume is mirrored along z, y, x by its bits 0, 1, 2, and has its own windows; told by places in the
    volume itself, most are windows of several copies: a bit of `mirrors` for each. Copies that differ in the bits of `apart`
    have different windows. Axes that are padded in front are so before the volume is mirrored: all copies have that window."""
    kind = sizes.schema[key].dataType

    def run(batches):
        for batch in batches:
            rows = []
            for k, n in enumerate(zip(*[batch.column(a).to_pylist() for a in "dhw"], strict=True)):
                plain = [starts(s, window, overlap, in_front) for s in n]
                turned = [p if in_front and s < window else sorted(s - window - x for x in p) for s, p in zip(n, plain, strict=True)]
                apart = sum((p != t) << i for i, (p, t) in enumerate(zip(plain, turned, strict=True)))
                found: dict[tuple, int] = {}
                for m in range(mirrors):
                    for at in product(*[t if m >> i & 1 else p for i, (p, t) in enumerate(zip(plain, turned, strict=True))]):
                        found[at] = found.get(at, 0) | 1 << m
                rows += [(k, *at, bits, apart) for at, bits in found.items()]
            row, *numbers = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in numbers]], [key, "z", "y", "x", "mirrors", "apart"])

    found = sizes.select(key, "d", "h", "w").mapInArrow(run, f"{key} {kind.simpleString()}, z int, y int, x int, mirrors int, apart int")
    return found.select(F.struct(key, "z", "y", "x", "mirrors", "apart").alias("id"))


def predicted(volumes: DataFrame, key: str, edge: int, window: int, make: Callable[[], Predictor], overlap: float = 0.5, mirrored: bool = True, in_front: bool = False) -> DataFrame:
    """Chunks of the predictor's output for whole volumes; the mean over eight mirrored copies if they are wanted.

    make() gives the predictor, which takes and gives (n, window, window, window); each worker makes it once. Tiles are cut
    out of chunks with what lies beyond the volume as 0; a volume smaller than the window is padded on both sides, once it is
    mirrored, or in front, before that. A tile's output goes on in pieces, one for each chunk it touches, and
    is summed up there with its weights: what is shuffled are arrays, and a task holds some tiles or some chunks. Volumes that
    lack voxels are left out."""
    mirrors, job, weights = (8 if mirrored else 1), uuid.uuid4().hex, importance(window)
    there = c.extents(volumes, key, edge).where("whole")
    wanted = tiles(there, key, window, overlap, mirrors, in_front)
    boxes = wanted.select("id", f"id.{key}", "id.z", "id.y", "id.x", *[F.lit(window).alias(n) for n in "dhw"])
    held = cut_boxes(boxes, volumes, key, edge).groupBy("id").agg(F.collect_list("part").alias("parts"))
    turn = lambda x, m: np.flip(x, [i for i in range(3) if m >> i & 1]) if m else x
    kind = volumes.schema[key].dataType.simpleString()
    names = [key, "cz", "cy", "cx", "copies", *PART, "oz", "oy", "ox", "v"]

    def predict(batches):
        from voxloom.operators import sliding

        for batch in batches:
            if job not in sliding._made:
                sliding._made[job] = make()
            ids = dict(zip([key, "z", "y", "x", "mirrors", "apart"], batch.column("id").flatten(), strict=True))
            at = np.stack([np.asarray(ids[a], dtype=np.int64) for a in "zyx"], 1)
            mirrors_of, apart = np.asarray(ids["mirrors"]).tolist(), np.asarray(ids["apart"]).tolist()
            lists = batch.column("parts")
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            fields = dict(zip([*PART, "v"], lists.flatten().flatten(), strict=True))
            numbers = np.stack([np.asarray(fields[n], dtype=np.int64) for n in PART], 1).tolist()
            cut = np.concatenate([[0], np.cumsum(np.asarray(fields["v"].value_lengths()))])
            values = np.asarray(fields["v"].flatten(), dtype=float)
            for k in range(len(at)):
                mine = range(ends[k], ends[k + 1])
                cube = filled(((*numbers[i], values[cut[i] : cut[i + 1]]) for i in mine), (window,) * 3)
                known, cube = np.where(np.isnan(cube), np.nan, weights), np.nan_to_num(cube)
                copies = [m for m in range(8) if mirrors_of[k] >> m & 1]
                given = np.stack([turn(cube, m) for m in copies])
                got = np.concatenate([sliding._made[job](given[i : i + AT_ONCE]) for i in range(0, len(given), AT_ONCE)])
                alike: dict[int, np.ndarray] = {}  # copies that share all windows share their weights
                for m, x in zip(copies, got, strict=True):
                    alike[m & apart[k]] = alike.get(m & apart[k], 0) + turn(x, m)
                out = [[] for _ in names[1:]]
                for group, x in alike.items():
                    weighted = x * known  # NaN beyond the volume, as in its chunks
                    for i in mine:
                        z, y, w, d, h, e = numbers[i]
                        place = at[k] + [z, y, w]
                        for to, value in zip(out, [*(place // edge), group, *(place % edge), d, h, e, z, y, w, weighted[z : z + d, y : y + h, w : w + e]], strict=True):
                            to.append(value)
                of = ids[key].take(pa.array(np.full(len(out[0]), k)))
                yield pa.RecordBatch.from_arrays([of, *[pa.array(np.array(x, np.int32)) for x in out[:-1]], c._ragged(out[-1])], names)

    pieces = held.mapInArrow(predict, f"{key} {kind}, {', '.join(f'{n} int' for n in names[1:-1])}, v array<double>")
    summed = pieces.groupBy(key, "cz", "cy", "cx").agg(F.collect_list(F.struct(*names[4:])).alias("parts"))

    def add(batches):
        for batch in batches:
            lists = batch.column("parts")
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            fields = dict(zip(names[4:], lists.flatten().flatten(), strict=True))
            numbers = np.stack([np.asarray(fields[n], dtype=np.int64) for n in names[4:-1]], 1).tolist()
            cut = np.concatenate([[0], np.cumsum(np.asarray(fields["v"].value_lengths()))])
            values = np.asarray(fields["v"].flatten())
            cubes = np.zeros((len(lists), edge, edge, edge))
            for k in range(len(lists)):
                sums: dict[int, np.ndarray] = {}
                for i in range(ends[k], ends[k + 1]):
                    group, z, y, x, d, h, w, oz, oy, ox = numbers[i]
                    total = sums.setdefault(group, np.zeros((2, edge, edge, edge)))
                    total[0, z : z + d, y : y + h, x : x + w] += values[cut[i] : cut[i + 1]].reshape(d, h, w)
                    total[1, z : z + d, y : y + h, x : x + w] += weights[oz : oz + d, oy : oy + h, ox : ox + w]
                with np.errstate(invalid="ignore"):
                    cubes[k] = sum(total[0] / total[1] for total in sums.values()) / mirrors
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names[:4]], c._lists(cubes)], [key, "cz", "cy", "cx", "v"])

    return summed.mapInArrow(add, f"{key} {kind}, cz int, cy int, cx int, v array<double>")


def segmented(scores: DataFrame, threshold: float) -> DataFrame:
    """1 where the score is above the threshold, 0 elsewhere; chunks as they are."""
    return scores.withColumn("v", F.transform("v", lambda x: F.when(F.isnan(x), x).otherwise((x > threshold).cast("double"))))


def moments(volumes: DataFrame, key: str, edge: int) -> DataFrame:
    """key, n, mean, sd (of all voxels) of volumes in chunks: count, mean and squared deviations by chunk, merged by volume,
    which loses no digits where the mean is large."""
    def run(batches):
        for batch in batches:
            cubes = c._cubes(batch.column("v"), edge**3)
            n = (~np.isnan(cubes)).sum(1)
            mean = np.nansum(cubes, 1) / np.maximum(n, 1)
            square = np.nansum((cubes - mean[:, None]) ** 2, 1)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(square)], [key, "n", "mean", "square"])

    kind = volumes.schema[key].dataType.simpleString()
    parts = volumes.select(key, F.col("v").cast("array<double>")).mapInArrow(run, f"{key} {kind}, n long, mean double, square double")
    merged = parts.where("n > 0").groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("total"), F.sum("square").alias("within"), F.collect_list(F.struct("n", "mean")).alias("of"))
    mean = F.col("total") / F.col("n")
    between = F.aggregate("of", F.lit(0.0), lambda a, x: a + x["n"] * (x["mean"] - mean) * (x["mean"] - mean))
    return merged.select(key, "n", mean.alias("mean"), F.sqrt((F.col("within") + between) / F.col("n")).alias("sd"))


def scaled(volumes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Chunks of (v - mean) / sd, by the moments that are known of their volume; null voxels where the deviation is 0."""
    v = F.transform("v", lambda x: (x - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)))
    return volumes.join(known, key).withColumn("v", v).select(key, "cz", "cy", "cx", "v")


def normalised(volumes: DataFrame, key: str, edge: int) -> DataFrame:
    """Chunks of (v - mean) / sd of their volume; null voxels where the deviation is 0."""
    return scaled(volumes, moments(volumes, key, edge), key)


@contextmanager
def loaded(volumes: DataFrame, key: str, edge: int):
    """normalised() volumes for several uses within a block. Their moments are written and the volumes are scanned once more
    at the first use; from then on executors hold the normalised chunks, and further uses scan nothing."""
    known = storage.written(moments(volumes, key, edge), "moments")
    try:
        with storage.held(scaled(volumes, known, key)) as ready:
            yield ready
    finally:
        storage.removed(known)
