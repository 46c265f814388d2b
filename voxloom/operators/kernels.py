"""Dense kernels that no SQL expression gives: Fourier filters, rotation, labelling, spline fits. Arrow batches of whole
cubes, or one volume at a time; a volume is bounded, a run's points are not and are summed before any fit."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import chunks, geometry
from voxloom.sources import storage

#: Tasks that share the points of a run.
PARTS = 4


def each_cube(samples: DataFrame, change: Callable[[np.ndarray, int], np.ndarray], side: int, only: Column | None = None) -> DataFrame:
    """sample_id and v after change(cube, sample_id), where `only` is true if it is given."""
    def run(batches):
        for batch in batches:
            ids, on = batch.column("sample_id").to_pylist(), batch.column("_on").to_pylist()
            held = [np.asarray(v.values) for v in batch.column("v")]
            cubes = [change(v.reshape(side, side, side), i).ravel() if o else v for v, i, o in zip(held, ids, on, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(cubes, pa.list_(pa.float64()))], ["sample_id", "v"])

    on = F.lit(True) if only is None else only
    return samples.select("sample_id", "v", on.alias("_on")).mapInArrow(run, "sample_id long, v array<double>")


def cosine_weights(r: np.ndarray, low_pass: float, low_decay: float, high_pass: float, high_decay: float) -> np.ndarray:
    """The cosine band-pass weights at distances r, in pixels of the spectrum; see volume.cosine_mask."""
    def edge(f: float, d: float) -> np.ndarray:
        if not f:
            return np.ones(r.shape)
        if not d:
            return (r <= f).astype(float)
        return np.where(r <= f - d / 2, 1.0, np.where(r >= f + d / 2, 0.0, 0.5 + 0.5 * np.cos(np.pi * (r - (f - d / 2)) / d)))

    high = np.ones(r.shape) if not high_pass else 1 - edge(high_pass, high_decay) if high_decay else (r >= high_pass).astype(float)
    return edge(low_pass, low_decay) * high


def mask(shape: tuple[int, ...], low_pass: float, low_decay: float, high_pass: float, high_decay: float) -> np.ndarray:
    """The weights of a whole spectrum, centred."""
    r = np.sqrt(sum((g - n // 2) ** 2 for g, n in zip(np.indices(shape), shape, strict=True)))
    return cosine_weights(r, low_pass, low_decay, high_pass, high_decay)


def bandpass(samples: DataFrame, side: int, low_pass: float = 0, low_decay: float = 0, high_pass: float = 0, high_decay: float = 0) -> DataFrame:
    weights = np.fft.ifftshift(mask((side,) * 3, low_pass, low_decay, high_pass, high_decay))
    return each_cube(samples, lambda v, _: np.fft.ifftn(np.fft.fftn(v) * weights).real, side)


def fourier_augment(samples: DataFrame, side: int, drop: float = 0.1, noise: float = 0.1, scale: tuple[float, float] = (0.8, 1.2), prob: float = 1.0, seed: int = 0, only: Column | None = None) -> DataFrame:
    """Frequencies dropped, phases disturbed and intensity scaled, by draws of the seed and the sample."""
    def change(v: np.ndarray, i: int) -> np.ndarray:
        r = np.random.default_rng([seed, i & (2**63 - 1)])
        if r.random() >= prob:
            return v
        spectrum = np.fft.fftshift(np.fft.fftn(v))
        spectrum = np.abs(spectrum) * (r.random(v.shape) >= drop) * np.exp(1j * (np.angle(spectrum) + r.normal(0, noise, v.shape)))
        return np.fft.ifftn(np.fft.ifftshift(spectrum)).real * r.uniform(*scale)

    return each_cube(samples, change, side, only)


def rotate(samples: DataFrame, side: int, degrees: float, axes: tuple[int, int] = (1, 2)) -> DataFrame:
    """Rotation around the voxel side // 2, trilinear, 0 outside."""
    def change(v: np.ndarray, _: int) -> np.ndarray:
        at = np.indices(v.shape).astype(float)
        p, q = axes
        a, b = at[p] - side // 2, at[q] - side // 2
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        at[p], at[q] = c * a + s * b + side // 2, -s * a + c * b + side // 2
        low = np.floor(at).astype(int)
        part, out = at - low, np.zeros(v.shape)
        for corner in np.ndindex(2, 2, 2):
            place, weight, inside = [], np.ones(v.shape), np.ones(v.shape, bool)
            for k in range(3):
                x = low[k] + corner[k]
                weight = weight * (part[k] if corner[k] else 1 - part[k])
                inside &= (x >= 0) & (x < side)
                place.append(np.clip(x, 0, side - 1))
            out += np.where(inside, weight * v[tuple(place)], 0.0)
        return out

    return each_cube(samples, change, side)


def components(mask: DataFrame, edge: int = 16) -> DataFrame:
    """run, z, y, x, component: set voxels, given by their places, labelled by 26-neighbour connection (chunks.components)."""
    held = chunks.chunked(mask.select("run", "z", "y", "x", F.lit(1.0).alias("v")), "run", edge)
    labelled = chunks.flat(chunks.components(held, "run", edge), "run", edge)
    return labelled.where("v > 0").select("run", "z", "y", "x", F.col("v").cast("long").alias("component"))


def basis(t: np.ndarray, knots: int) -> np.ndarray:
    """Uniform cubic B-splines over 0..1, one column for each of the control points (at least four)."""
    u = np.clip(t, 0, 1) * (knots - 3)
    low = np.minimum(u.astype(int), knots - 4)
    f = u - low
    out = np.zeros((len(t), knots))
    for k, b in enumerate(((1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6)):
        out[np.arange(len(t)), low + k] += b
    return out


def bending(knots: int) -> np.ndarray:
    """The quadratic form of the mean squared second differences of control points along both axes."""
    d = np.diff(np.eye(knots), 2, axis=0)
    return (np.kron(d.T @ d, np.eye(knots)) + np.kron(np.eye(knots), d.T @ d)) / (knots * (knots - 2))


def least_root(gram: np.ndarray, by: np.ndarray, square: float, penalty: np.ndarray, gauge: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The c that makes sqrt(c'Gc - 2 by'c + square) + c'Pc least, from sums over points alone.

    The root is convex and lies below any of its tangents in its square, so each round solves normal equations in which
    the penalty weighs twice the root so far, and the sum never grows."""
    solve = lambda weight: np.linalg.lstsq(gram + weight * penalty + np.outer(gauge, gauge), by, rcond=None)[0]
    root = lambda c: float(np.sqrt(max(0.0, c @ gram @ c - 2 * by @ c + square)))
    c = solve(0.0)
    if not penalty.any():
        return c
    was = None
    for _ in range(rounds):
        now = root(c)
        if was is not None and abs(now - was) <= 1e-12 * (1 + was):
            break
        was, c = now, solve(2 * now)
    return c


def spline_fit(points: DataFrame, width: float, height: float, knots: int = 5, stiffness: float = 1e-3, depth: float = 1.0) -> DataFrame:
    """One surface for each run, with an offset for each of its layers: run, control (knots * knots), top, bottom, n, error.

    The surface makes the root of the squared errors, plus stiffness times the bending of its control points, least, heights
    counted in units of depth; without stiffness it is the surface of least squares. The points of a run, dealt over a few tasks, are reduced to sums of products there: one
    array for each run and task, PARTS at most, which meet where a small system is solved for each run. A run with fewer than three points has an error instead. points: run, layer, x, y, z."""
    k = knots * knots
    m = k + 2
    upper = np.triu_indices(m + 1)  # of products of the columns and z

    def products(batches):
        """Rows come sorted by run; one row of sums leaves for each run."""
        at, held = None, 0.0
        for batch in batches:
            run, x, y, z = (np.asarray(batch.column(c)) for c in ("run", "x", "y", "z"))
            on = [np.asarray(batch.column("layer").to_pandas() == name)[:, None] for name in ("top", "bottom")]
            x, y = basis(x / width, knots), basis(y / height, knots)
            a = np.concatenate([(y[:, :, None] * x[:, None, :]).reshape(len(z), k), *on, z[:, None] / depth], 1).astype(float)
            begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else []
            rows = []
            for i, j in zip(begin, [*begin[1:], len(run)], strict=True):
                sums = np.append((a[i:j].T @ a[i:j])[upper], j - i)
                if at is not None and run[i] != at:
                    rows.append((at, held))
                    held = 0.0
                at, held = run[i], held + sums
            yield given(rows)
        if at is not None:
            yield given([(at, held)])

    def given(rows: list) -> pa.RecordBatch:
        sums = np.array([x for _, x in rows]).reshape(len(rows), len(upper[0]) + 1)
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), chunks._lists(sums)], ["run", "sums"])

    def solve(batches):
        penalty, gauge = np.zeros((m, m)), np.zeros(m)
        penalty[:k, :k] = stiffness * bending(knots)
        gauge[:k] = 1  # the surface's mean is 0, the offsets carry the height
        for batch in batches:
            lists, out = batch.column("sums"), []
            flat = np.asarray(lists.flatten().flatten()).reshape(-1, len(upper[0]) + 1)
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            for i, j in zip([0, *ends[:-1]], ends, strict=False):
                whole, s = np.zeros((m + 1, m + 1)), flat[i:j].sum(0)
                if s[-1] < 3:
                    out.append((None, None, None, int(s[-1]), "fewer than three points"))
                    continue
                whole[upper] = s[:-1]
                whole.T[upper] = s[:-1]
                c = depth * least_root(whole[:m, :m], whole[:m, m], whole[m, m], penalty, gauge)
                out.append((c[:k], c[k], c[k + 1], int(s[-1]), None))
            kinds = (pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("run"), *[pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]], ["run", "control", "top", "bottom", "n", "error"])

    dealt = points.where("run IS NOT NULL").select(F.col("run").cast("long").alias("run"), "layer", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.lit(PARTS)))
    together = dealt.repartition("run", "part").sortWithinPartitions("run").drop("part")
    partial = together.mapInArrow(products, "run long, sums array<double>")
    whole = partial.groupBy("run").agg(F.collect_list("sums").alias("sums"))
    return whole.mapInArrow(solve, "run long, control array<double>, top double, bottom double, n long, error string")


def spline_lattice(fits: DataFrame, rows: int, cols: int, knots: int = 5) -> DataFrame:
    """run, layer, row, col, z of the fitted surfaces at rows * cols places; runs with an error have none."""
    y, x = basis(np.linspace(0, 1, rows), knots), basis(np.linspace(0, 1, cols), knots)
    step = max(1, chunks.HELD // (16 * rows * cols))

    def evaluate(batches):
        for given in batches:
            for start in range(0, given.num_rows, step):
                batch = given.slice(start, step)
                n = batch.num_rows
                control = np.asarray(batch.column("control").flatten()).reshape(n, knots, knots)
                z = y @ control @ x.T
                both = np.stack([z + np.asarray(batch.column(c))[:, None, None] for c in ("top", "bottom")], 1)
                run = batch.column("run").take(pa.array(np.repeat(np.arange(n), 2 * rows * cols)))
                layer = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.repeat(np.int32([0, 1]), rows * cols), n)), pa.array(["top", "bottom"])).cast(pa.string())
                place = np.broadcast_to(np.indices((rows, cols), np.int32)[:, None], (2, 2 * n, rows, cols)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([run, layer, *map(pa.array, place), pa.array(both.reshape(-1))], ["run", "layer", "row", "col", "z"])

    return fits.where("error IS NULL").mapInArrow(evaluate, "run long, layer string, row int, col int, z double")


METHODS = ("spline", "coupled", "parallel")


def slab(points: DataFrame, method: str, width: float, height: float, rows: int, cols: int, knots: int = 5) -> DataFrame:
    """run, layer, row, col, z: two surfaces for each run, by one of three methods.

    coupled: one spline surface with an offset for each layer; spline: one for each layer by itself; parallel: two planes of
    one slope. Runs with too few points have no rows."""
    if method == "coupled":
        return spline_lattice(spline_fit(points, width, height, knots), rows, cols, knots)
    if method == "spline":
        own = points.withColumn("run", F.col("run") * 2 + (F.col("layer") == "top").cast("int")).withColumn("layer", F.lit("top"))
        both = spline_lattice(spline_fit(own, width, height, knots), rows, cols, knots).where("layer = 'top'")
        return both.withColumn("layer", F.when(F.col("run") % 2 == 1, "top").otherwise("bottom")).withColumn("run", F.floor(F.col("run") / 2))
    if method == "parallel":
        planes = geometry.parallel_planes(points)
        sides = F.explode(F.array(*[F.struct(F.lit(s).alias("layer"), F.col(s).alias("c")) for s in ("top", "bottom")]))
        each = planes.select("run", "a", "b", sides.alias("s")).select("run", "a", "b", "s.*")
        at = each.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        z = F.col("a") * F.col("col") * width / (cols - 1) + F.col("b") * F.col("row") * height / (rows - 1) + F.col("c")
        return at.select("run", "layer", "row", "col", z.alias("z"))
    raise ValueError(f"unknown method {method!r}, not one of {METHODS}")


def planes_by_overlap(mask: DataFrame, edge: int, iterations: int = 20, rate: float = 0.1, steep: float = 1000.0) -> DataFrame:
    """run, nz, ny, nx, top, bottom, iou: two parallel planes whose slab overlaps most with what is set in chunks of 0 and 1.

    The overlap of the slab's soft mask with the volume is raised by Adam from a level normal and offsets of -0.8 and -0.2,
    coordinates scaled to 0..1. Overlap and gradient are made of nineteen sums over voxels, which every chunk gives for itself,
    so a step is one aggregation by run and a task holds some chunks. Chunks are kept as bits; steps are written, each run's
    state is a row."""
    names = [f"s{i}" for i in range(19)]

    def pack(batches):
        for batch in batches:
            v = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1) > 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("run", "cz", "cy", "cx")], pa.array([np.packbits(x).tobytes() for x in v], pa.binary())], ["run", "cz", "cy", "cx", "bits"])

    def sums(batches):
        sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -500, 500)))
        for whole in batches:
            step = max(1, chunks.HELD // (16 * edge**3))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                n = batch.num_rows
                vol = np.stack([np.unpackbits(np.frombuffer(b, np.uint8))[: edge**3] for b in batch.column("bits").to_pylist()]).reshape(n, edge, edge, edge).astype(float)
                at, size = (np.stack([np.asarray(batch.column(c)) for c in cs], 1) for cs in (("cz", "cy", "cx"), "dhw"))
                zz, yy, xx = (((at[:, k : k + 1] * edge + np.arange(edge)) / size[:, k : k + 1]).reshape(n, *[edge if j == k else 1 for j in range(3)]) for k in range(3))
                p = np.asarray(batch.column("p").flatten()).reshape(n, 5)
                part = lambda x: x.reshape(n, 1, 1, 1)
                nz, ny, nx = (part(c) for c in (p[:, :3] / np.linalg.norm(p[:, :3], axis=1, keepdims=True)).T)
                flat = nx * yy + ny * xx  # the normal's last two parts go with y and x in this order
                top, bottom = -(flat + part(p[:, 3])) / nz, -(flat + part(p[:, 4])) / nz
                a, b = sigmoid(steep * (top - zz)), sigmoid(steep * (zz - bottom))
                valid = a * b
                out = [valid * vol, valid, vol]
                for slope, z in ((steep * (1 - a), top), (-steep * (1 - b), bottom)):
                    for w in (z, xx, yy, 1.0):
                        out += [valid * vol * slope * w, valid * slope * w]
                columns = [pa.array(np.broadcast_to(x, vol.shape).reshape(n, -1).sum(1)) for x in out]
                yield pa.RecordBatch.from_arrays([batch.column("run"), *columns], ["run", *names])

    def moved(batches):
        for batch in batches:
            both, valid, vol, *rest = (np.asarray(batch.column(c)) for c in names)
            union = valid + vol - both
            g = [x * (union + both) / union**2 - y * both / union**2 for x, y in zip(rest[::2], rest[1::2], strict=True)]
            p, m, u = (np.asarray(batch.column(c).flatten()).reshape(-1, 5) for c in "pmu")
            length = np.linalg.norm(p[:, :3], axis=1, keepdims=True)
            n = p[:, :3] / length
            by_n = -np.stack([g[k] + g[k + 4] for k in range(3)], 1) / n[:, :1]
            by_p = (by_n - n * (by_n * n).sum(1, keepdims=True)) / length
            down = -np.concatenate([by_p, -np.stack([g[3], g[7]], 1) / n[:, :1]], 1)
            t = np.asarray(batch.column("t"))[:, None] + 1
            m, u = 0.9 * m + 0.1 * down, 0.999 * u + 0.001 * down * down
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
            arrays = [pa.array(list(x), pa.list_(pa.float64())) for x in (p, m, u)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("run", "d", "h", "w")], pa.array(t[:, 0].astype(np.int32)), *arrays], ["run", "d", "h", "w", "t", "p", "m", "u"])

    kind = mask.schema["run"].dataType.simpleString()
    bits = mask.select("run", "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(pack, f"run {kind}, cz int, cy int, cx int, bits binary")
    bits = storage.written(bits, "bits")
    zero = F.array(*[F.lit(0.0)] * 5)
    begin = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, -0.8, -0.2)])  # normal z, y, x; top, bottom
    sizes = [((F.max(f"c{a}") + 1) * edge).cast("int").alias(n) for a, n in zip("zyx", "dhw", strict=True)]
    state = storage.written(bits.groupBy("run").agg(*sizes).select("*", F.lit(0).alias("t"), begin.alias("p"), zero.alias("m"), zero.alias("u")), "planes")

    def summed(state: DataFrame) -> DataFrame:
        parts = bits.join(state.select("run", "d", "h", "w", "p"), "run").mapInArrow(sums, f"run {kind}, {', '.join(f'{c} double' for c in names)}")
        return parts.groupBy("run").agg(*[F.sum(c).alias(c) for c in names])

    for _ in range(iterations):
        after = storage.written(summed(state).join(state, "run").mapInArrow(moved, f"run {kind}, d int, h int, w int, t int, p array<double>, m array<double>, u array<double>"), "planes")
        storage.removed(state)
        state = after
    iou = F.col("s0") / (F.col("s1") + F.col("s2") - F.col("s0"))
    return summed(state).join(state, "run").select("run", *[F.get("p", i).alias(n) for i, n in enumerate(("nz", "ny", "nx", "top", "bottom"))], iou.alias("iou"))
