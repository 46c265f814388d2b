"""Points and boxes in volumes: unit conversion, background sampling, extraction of boxes, grids and regions.

Boxes meet volumes by chunk: a box names the chunks that it overlaps, a chunk gets the list of its boxes, and the overlaps are
cut out of its array at once. What is shuffled are chunks and places, and one array for each box and chunk. Volumes are never
joined with points of other runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import number, rng
from voxloom.sources import storage

XYZ = ("x", "y", "z")
#: Boxes that a chunk is sent with at once, about; lists of them that are looked at, and voxels that are cut out, at once.
AT_ONCE, LISTS, HELD = 1024, 32, 250_000
#: Picks, or background points, of a run whose background is sought beside the list of its picks.
FEW = 256


def to_voxels(picks: DataFrame, spacing: float) -> DataFrame:
    return picks.withColumns({a: F.col(a) / spacing for a in XYZ})


def to_index(picks: DataFrame, spacing: float) -> DataFrame:
    """Voxel indexes, truncated towards zero."""
    return picks.withColumns({a: (F.col(a) / spacing).cast("int") for a in XYZ})


def random_place(side: int, box: int, seed: str, whole: bool, attempt: Column) -> list[Column]:
    """x, y, z of the box-safe random place that a run's attempt gives."""
    room, low = side - box, box // 2
    place = (lambda u: F.floor(u * (room + 1)).cast("int") + low) if whole else (lambda u: u * room + low)
    return [place(rng.uniform(f"{seed}-{a}", "run", attempt)).alias(a) for a in XYZ]


def candidates(wanted: DataFrame, side: int, box: int, seed: str, whole: bool = True, first: int = 0, end: int = 10) -> DataFrame:
    """run, attempt, want, x, y, z: box-safe random places for the background points that runs want (run, want), those of
    attempts first * want to end * want."""
    tried = wanted.withColumn("attempt", F.explode(F.sequence(F.col("want") * first, F.col("want") * end - 1)))
    return tried.select("run", "attempt", "want", *random_place(side, box, seed, whole, F.col("attempt")))


def squared(one: list[Column], other: list[Column]) -> Column:
    """The square of the distance."""
    return sum(((a - b) * (a - b) for a, b in zip(one, other, strict=True)), F.lit(0.0))


def apart_from(places: DataFrame, picks: DataFrame, distance: float) -> DataFrame:
    """The places at least `distance` from every pick of their run.

    Cells are twice the distance wide. A pick is in those that its ball touches, eight at most, and a place looks into its
    own, so it is compared with picks nearby only."""
    near = picks.select("run", *[F.col(a).alias(f"p{a}") for a in XYZ])
    cell = lambda x: F.floor(x / (2 * distance)).cast("int")
    for a in XYZ:
        near = near.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(f"p{a}") - distance), cell(F.col(f"p{a}") + distance))))
    placed = places.withColumns({f"c{a}": cell(F.col(a)) for a in XYZ})
    apart = squared([F.col(f"f.{a}") for a in XYZ], [F.col(f"n.p{a}") for a in XYZ])
    same = [F.col(f"f.{c}") == F.col(f"n.{c}") for c in ("run", "cx", "cy", "cz")]
    free = placed.alias("f").join(near.alias("n"), same[0] & same[1] & same[2] & same[3] & (apart < distance * distance), "left_anti")
    return free.drop("cx", "cy", "cz")


def background(picks: DataFrame, side: int, box: int, distance: float, ratio: float = 0.2, seed: str = "background", whole: bool = True, attempts: int = 10) -> DataFrame:
    """Places at least `distance` voxels from every pick of the run: the first ones by attempt, as many as wanted, which is
    int(picks * ratio) a run. picks are in voxels.

    Runs of up to FEW picks and points, which are most, are each made where the list of their picks is. Larger ones go by cells."""
    placed = picks.where("run IS NOT NULL").select("run", *XYZ)
    sizes = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    large = storage.written(sizes.where(F.col("n") * max(ratio, 1.0) > FEW).select("run"), "large")
    if large.isEmpty():
        return background_by_list(placed, side, box, distance, ratio, seed, whole, attempts)
    few, many = placed.join(large, "run", "left_anti"), placed.join(large, "run", "left_semi")
    return background_by_list(few, side, box, distance, ratio, seed, whole, attempts).unionByName(background_by_cell(many, side, box, distance, ratio, seed, whole, attempts))


def background_by_list(picks: DataFrame, side: int, box: int, distance: float, ratio: float, seed: str, whole: bool, attempts: int) -> DataFrame:
    """background() of runs with few picks each. Picks are shuffled once, by run, and nothing else is: a run's attempts are made
    beside the list of its picks, in rounds of as many as it wants, until there are enough."""
    lists = picks.repartition("run").groupBy("run").agg(F.collect_list(F.struct(*XYZ)).alias("near"))
    wanted = lists.withColumn("want", F.floor(F.size("near") * F.lit(ratio)).cast("int")).where("want > 0")

    def touched(place):
        at = [place[a] for a in XYZ]
        return F.coalesce(F.exists("near", lambda p: squared(at, [p[a] for a in XYZ]) < distance * distance), F.lit(False))

    def more(found, k):
        tries = F.transform(F.sequence(F.col("want") * k, F.col("want") * (k + 1) - 1), lambda i: F.struct(i.alias("attempt"), *random_place(side, box, seed, whole, i)))
        return F.when(F.size(found) >= F.col("want"), found).otherwise(F.concat(found, F.filter(tries, lambda place: ~touched(place))))

    kind = "int" if whole else "double"
    none = F.array().cast(f"array<struct<attempt:int,{','.join(f'{a}:{kind}' for a in XYZ)}>>")
    found = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), none, more)
    return wanted.select("run", F.inline(F.slice(found, F.lit(1), F.col("want"))))


def background_by_cell(picks: DataFrame, side: int, box: int, distance: float, ratio: float, seed: str, whole: bool, attempts: int) -> DataFrame:
    """background() of runs of any size, none of which is whole in a task.

    Two attempts for each point go first and are written; only runs that lack points after that make the others."""
    want = picks.groupBy("run").agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).cast("int").alias("want")).where("want > 0")
    early = storage.written(apart_from(candidates(want, side, box, seed, whole, 0, 2), picks, distance), "background")
    found = early.groupBy("run").agg(F.count(F.lit(1)).alias("found"))
    short = storage.written(want.join(found, "run", "left").where("coalesce(found, 0) < want").select("run", "want"), "short")
    late = apart_from(candidates(short, side, box, seed, whole, 2, attempts), picks.join(short.select("run"), "run", "left_semi"), distance)
    ranked = number.numbered(early.unionByName(late), ["run"], number.of_ids("attempt"), ["attempt"], "rank")
    return ranked.where("rank <= want").select("run", "attempt", *XYZ)


def with_background(picks: DataFrame, points: DataFrame) -> DataFrame:
    """Picks and background points as one table of samples."""
    own = picks.select("run", F.col("object_name").alias("key"), F.lit(False).alias("is_background"), *[F.col(a).cast("double").alias(a) for a in XYZ])
    return own.unionByName(points.select("run", F.lit("background").alias("key"), F.lit(True).alias("is_background"), *[F.col(a).cast("double").alias(a) for a in XYZ]))


def boxes(points: DataFrame, box: int, side: int, shift: dict[str, Column] | None = None, centred_pad: bool = False) -> DataFrame:
    """point_id, run and for each axis the clipped range lo..hi and pad, where it goes in the box; and status.

    The range is max(0, int(c - h)) .. min(side, int(c + h)); an empty one makes the box invalid. The pad is
    max(0, h - int(c)), or half the missing length if the block is to be centred. The shift moves the centre."""
    h, out = box // 2, points
    for a in XYZ:
        c = F.col(a) + (shift[a] if shift else 0)
        lo, hi = F.greatest(F.lit(0), (c - h).cast("int")), F.least(F.lit(side), (c + h).cast("int"))
        pad = F.floor((box - (hi - lo)) / 2).cast("int") if centred_pad else F.greatest(F.lit(0), h - c.cast("int"))
        out = out.withColumns({f"{a}_lo": lo, f"{a}_hi": hi, f"{a}_pad": pad})
    length = {a: F.col(f"{a}_hi") - F.col(f"{a}_lo") for a in XYZ}
    empty = (length["x"] <= 0) | (length["y"] <= 0) | (length["z"] <= 0)
    full = (length["x"] == box) & (length["y"] == box) & (length["z"] == box)
    status = F.when(empty, "invalid").when(full, "valid").otherwise("padded")
    return out.select("point_id", "run", status.alias("status"), *[f"{a}_{k}" for a in XYZ for k in ("lo", "hi", "pad")])


def pieces(placed: DataFrame, chunks: DataFrame, edge: int) -> DataFrame:
    """point_id, status, z, y, x, d, h, w, v: what a box takes from one chunk, its place within the box, its size.

    The boxes of a chunk are sent to it together, in lists of a bounded size, and cut out of its array at once."""
    tiles = placed.where("status <> 'invalid'")
    for a in XYZ:
        tiles = tiles.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}_lo") / edge).cast("int"), F.floor((F.col(f"{a}_hi") - 1) / edge).cast("int"))))
    for a in XYZ:  # the overlap in the chunk's own coordinates, from first to end
        tiles = tiles.withColumn(f"{a}_first", F.greatest(F.col(f"{a}_lo") - F.col(f"c{a}") * edge, F.lit(0)))
        tiles = tiles.withColumn(f"{a}_n", F.least(F.col(f"{a}_hi") - F.col(f"c{a}") * edge, F.lit(edge)) - F.col(f"{a}_first"))
    place = [(F.col(f"c{a}") * edge + F.col(f"{a}_first") - F.col(f"{a}_lo") + F.col(f"{a}_pad")).cast("int").alias(a) for a in "zyx"]
    sizes = [F.col(f"{a}_n").cast("int").alias(n) for a, n in zip("zyx", "dhw", strict=True)]
    first = [F.col(f"{a}_first").cast("int").alias(f"{a}_first") for a in "zyx"]
    at = ["run", "cz", "cy", "cx"]
    narrow = tiles.select(*at, "point_id", F.struct("point_id", "status", *place, *sizes, *first).alias("box"))
    many = F.ceil(F.count(F.lit(1)).over(W.partitionBy(*at)) / AT_ONCE)
    lists = narrow.withColumn("_list", F.pmod(F.xxhash64("point_id"), many)).groupBy(*at, "_list").agg(F.collect_list("box").alias("boxes"))
    met = lists.join(chunks.select(*at, F.col("v").cast("array<double>").alias("v")), at)
    names = ["point_id", "status", "z", "y", "x", "d", "h", "w"]

    def take(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, LISTS):
                batch = whole.slice(start, LISTS)
                boxes = dict(zip([*names, "z_first", "y_first", "x_first"], batch.column("boxes").flatten().flatten(), strict=True))
                of = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("boxes").value_lengths()))
                flat = np.asarray(batch.column("v").flatten())
                d, h, w, z, y, x = (np.asarray(boxes[c], dtype=np.int64) for c in ("d", "h", "w", "z_first", "y_first", "x_first"))
                ends = np.cumsum(d * h * w)
                for a, b in in_runs(ends, HELD):
                    part = slice(a, b)
                    size = (d * h * w)[part]
                    box = np.repeat(np.arange(a, b), size)
                    i = np.arange(len(box)) - np.repeat(np.cumsum(size) - size, size)
                    from_z, from_y, from_x = z[box] + i // (h * w)[box], y[box] + i // w[box] % h[box], x[box] + i % w[box]
                    values = flat[((of[box] * edge + from_z) * edge + from_y) * edge + from_x]
                    starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*[boxes[c].slice(a, b - a) for c in names], pa.ListArray.from_arrays(starts, pa.array(values))], [*names, "v"])

    kind = placed.schema["point_id"].dataType.simpleString()
    return met.select("boxes", "v").mapInArrow(take, f"point_id {kind}, status string, z int, y int, x int, d int, h int, w int, v array<double>")


def in_runs(ends: np.ndarray, most: int):
    """Ranges (from, to) of items whose sizes sum up to about `most` each; ends are the sizes' running sums."""
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def cut(placed: DataFrame, chunks: DataFrame, edge: int) -> DataFrame:
    """point_id, status, z, y, x, v: the voxels of the boxes, at their places within the box."""
    rows = pieces(placed, chunks, edge).select("*", F.posexplode("v").alias("i", "value"))
    at = {"z": F.floor(F.col("i") / (F.col("h") * F.col("w"))), "y": F.floor(F.col("i") / F.col("w")) % F.col("h"), "x": F.col("i") % F.col("w")}
    return rows.select("point_id", "status", *[(F.col(a) + at[a]).cast("int").alias(a) for a in "zyx"], F.col("value").alias("v"))


def assembled(parts: DataFrame, box: int) -> DataFrame:
    """point_id, status, v: whole boxes from pieces(), 0 where a box has no voxels. A group is the pieces of one box."""
    held = parts.groupBy("point_id", "status").agg(F.collect_list(F.struct("z", "y", "x", "d", "h", "w", "v")).alias("parts"))

    def fill(batches):
        for batch in batches:
            out = []
            for row in batch.column("parts"):
                whole = np.zeros((box, box, box))
                for p in row:
                    z, y, x, d, h, w = (p[k].as_py() for k in ("z", "y", "x", "d", "h", "w"))
                    whole[z : z + d, y : y + h, x : x + w] = np.asarray(p["v"].values).reshape(d, h, w)
                out.append(whole.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("status"), pa.array(out, pa.list_(pa.float64()))], ["point_id", "status", "v"])

    return held.mapInArrow(fill, f"point_id {parts.schema['point_id'].dataType.simpleString()}, status string, v array<double>")


def digest(parts: DataFrame, box: int) -> DataFrame:
    """One row for each box from its pieces(): voxels, their sum, and their sum weighted by place."""
    def sums(batches):
        for batch in batches:
            z, y, x, d, h, w = (np.asarray(batch.column(c), dtype=np.int64) for c in "zyxdhw")
            size, v = d * h * w, np.asarray(batch.column("v").flatten(), dtype=float)
            row, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            i = np.arange(len(v)) - first[row]
            place = ((z[row] + i // (h * w)[row]) * box + y[row] + i // w[row] % h[row]) * box + x[row] + i % w[row] + 1
            total, weighted = (np.bincount(row, u, minlength=len(size)) for u in (v, v * place))
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("status"), *map(pa.array, (size, total, weighted))], ["point_id", "status", "n", "total", "weighted"])

    kind = parts.schema["point_id"].dataType.simpleString()
    of_piece = parts.mapInArrow(sums, f"point_id {kind}, status string, n long, total double, weighted double")
    return of_piece.groupBy("point_id", "status").agg(
        F.sum("n").alias("n"), (F.round(F.sum("total"), 4) + F.lit(0.0)).alias("total"), (F.round(F.sum("weighted"), 3) + F.lit(0.0)).alias("weighted")
    )


def strategy_shift(strategy: str, box: int, seed: str = "patch") -> dict[str, Column] | None:
    """The offset of a box's centre: none, random within a quarter of half the box, or jittered by up to two voxels."""
    if strategy == "centered":
        return None
    if strategy not in ("random", "jittered"):
        raise ValueError(f"unknown patch strategy {strategy!r}")
    m = box // 2 // 4 if strategy == "random" else 2
    return {a: F.floor(rng.uniform(f"{seed}-{strategy}-{a}", "point_id") * (2 * m + 1)) - m for a in XYZ}


def grid_patches(runs: DataFrame, side: int, patch: int, overlap: float = 0.25) -> DataFrame:
    """Boxes on a regular grid over whole volumes: point_id, run, x, y, z at their centres."""
    if not 0 <= overlap < 1:
        raise ValueError("the overlap must be in [0, 1)")
    stride = max(1, int(patch * (1 - overlap)))
    starts = list(range(0, side - patch + 1, stride))
    out = runs.select("run").distinct()
    for a in "zyx":
        out = out.withColumn(a, F.explode(F.array(*[F.lit(s + patch // 2) for s in starts])))
    return out.withColumn("point_id", ((F.col("run") * side + F.col("z")) * side + F.col("y")) * side + F.col("x"))


def region(voxels: DataFrame, side: int, **ranges: tuple[int, int]) -> DataFrame:
    """The voxels of clipped ranges; an error if a range is empty."""
    clipped = {a: (max(0, lo), min(side, hi)) for a, (lo, hi) in ranges.items()}
    if any(lo >= hi for lo, hi in clipped.values()):
        raise ValueError("the region is empty")
    for a, (lo, hi) in clipped.items():
        voxels = voxels.where((F.col(a) >= lo) & (F.col(a) < hi))
    return voxels
