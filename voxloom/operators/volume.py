"""Dense volume operators. Cubes are arrays, z slowest; work on one cube stays in array expressions, and work across the
cubes of a volume goes by chunks with a halo (chunks.py)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import number, rng
from voxloom.functions.let import let
from voxloom.operators import chunks as c

AXES = {"z": 0, "y": 1, "x": 2}


def flat(samples: DataFrame, digits: int = 6) -> DataFrame:
    """sample_id, i, v: one row for each voxel."""
    return samples.select("sample_id", F.posexplode("v").alias("i", "v")).withColumn("v", F.round("v", digits))


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def zscore(samples: DataFrame, guarded: bool = False) -> DataFrame:
    """(v - mean) / (sd + 1e-6), or guarded: (v - mean) / sd where sd is above 0, else v. sd is the population's."""
    def scaled(mean: Column, sd: Column) -> Column:
        if guarded:
            return F.transform("v", lambda x: F.when(sd > 0, (x - mean) / sd).otherwise(x))
        return F.transform("v", lambda x: (x - mean) / (sd + 1e-6))

    deviation = lambda mean: F.sqrt(mean_of(F.transform("v", lambda x: (x - mean) * (x - mean))))
    return samples.withColumn("v", let(mean_of(F.col("v")), lambda mean: let(deviation(mean), lambda sd: scaled(mean, sd))))


def zscore_volumes(voxels: DataFrame) -> DataFrame:
    """Whole volumes by their own mean and deviation; null where a volume is constant."""
    of_run = voxels.groupBy("run").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return voxels.join(of_run, "run").select("run", "z", "y", "x", F.round(F.try_divide(F.col("v") - F.col("mean"), F.col("sd")), 6).alias("v"))


def brightness(samples: DataFrame, seed: str = "brightness") -> DataFrame:
    return samples.withColumn("v", let(rng.uniform(seed, "sample_id") - 0.5, lambda by: F.transform("v", lambda x: x + by)))


def intensity(samples: DataFrame, seed: str = "intensity") -> DataFrame:
    return samples.withColumn("v", let(rng.uniform(seed, "sample_id") + 0.5, lambda by: F.transform("v", lambda x: x * by)))


def moved(samples: DataFrame, source: list[int]) -> DataFrame:
    """Each voxel i takes the value at source[i]."""
    return samples.withColumn("v", F.transform(F.array(*[F.lit(i) for i in source]), lambda i: F.get("v", i)))


def flip(samples: DataFrame, axis: str, side: int) -> DataFrame:
    a = AXES[axis]
    return moved(samples, [_index([side - 1 - c if k == a else c for k, c in enumerate(p)], side) for p in _places(side)])


def rot90(samples: DataFrame, k: int, axes: tuple[str, str], side: int) -> DataFrame:
    """k quarter turns from the first axis towards the second."""
    p, q = (AXES[a] for a in axes)
    source = list(range(side**3))
    for _ in range(k % 4):
        turned = []
        for place in _places(side):
            at = list(place)
            at[p], at[q] = place[q], side - 1 - place[p]
            turned.append(source[_index(at, side)])
        source = turned
    return moved(samples, source)


def _places(side: int) -> list[tuple[int, int, int]]:
    return [(z, y, x) for z in range(side) for y in range(side) for x in range(side)]


def _index(place: list[int], side: int) -> int:
    return (place[0] * side + place[1]) * side + place[2]


def gates(samples: DataFrame, probabilities: dict[str, float], seed: str = "gate") -> DataFrame:
    """How many samples each augmentation applies to, by a draw for each sample and augmentation."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in probabilities.items()]))
    drawn = samples.select("sample_id", names.alias("g")).select("sample_id", "g.*")
    return drawn.where(rng.uniform(seed, "name", "sample_id") < F.col("p")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def mixup_partners(samples: DataFrame, seed: str = "mixup") -> DataFrame:
    """sample_id, partner_id, lam: another sample for each, never itself; none if there is only one."""
    n = samples.select("sample_id").count()
    if n < 2:
        return samples.sparkSession.createDataFrame([], "sample_id long, partner_id long, lam double")
    numbered = number.numbered(samples.select("sample_id"), [], number.of_ids("sample_id"), ["sample_id"], "idx").withColumn("idx", F.col("idx") - 1)
    at = (F.col("idx") + 1 + rng.integer(seed, n - 1, "sample_id")) % n
    chosen = numbered.withColumn("at", at).withColumn("lam", rng.uniform(f"{seed}-lambda", "sample_id"))
    return chosen.join(numbered.select(F.col("sample_id").alias("partner_id"), F.col("idx").alias("at")), "at").select("sample_id", "partner_id", "lam")


def mixup(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    other = samples.select(F.col("sample_id").alias("partner_id"), F.col("v").alias("w"))
    mixed = samples.join(pairs, "sample_id").join(other, "partner_id")
    return mixed.select("sample_id", F.zip_with("v", "w", lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b).alias("v"))


def batch_partners(samples: DataFrame, size: int, lam: float, seed: str = "batch") -> DataFrame:
    """Within batches of consecutive samples, partners by a random permutation."""
    batch = F.floor(F.col("sample_id") / size)
    ranked = samples.select("sample_id", batch.alias("batch"))
    of = W.partitionBy("batch")
    ranked = ranked.withColumn("own", F.row_number().over(of.orderBy("sample_id"))).withColumn("drawn", F.row_number().over(of.orderBy(rng.shuffle_key(seed, "sample_id"), "sample_id")))
    partner = ranked.select("batch", F.col("drawn").alias("own"), F.col("sample_id").alias("partner_id"))
    return ranked.join(partner, ["batch", "own"]).select("sample_id", "partner_id", F.lit(lam).alias("lam"))


def mixup_loss(losses: DataFrame) -> DataFrame:
    """lam * loss against the own label + (1 - lam) * loss against the partner's, squared errors of class ids."""
    own, other = F.pow(F.col("pred") - F.col("a"), F.lit(2)), F.pow(F.col("pred") - F.col("b"), F.lit(2))
    return losses.agg(F.round(F.avg(F.col("lam") * own + (1 - F.col("lam")) * other), 6).alias("loss"), F.round(F.avg(F.col("lam") * (F.col("pred") == F.col("a")).cast("int") + (1 - F.col("lam")) * (F.col("pred") == F.col("b")).cast("int")), 6).alias("accuracy"))


def kernel(side: int, sigma: float, truncate: float = 4.0) -> list[tuple[int, int, float]]:
    """(to, from, weight) of a Gaussian blur along one axis, mirrored at the edges."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    weights: dict[tuple[int, int], float] = {}
    for to in range(side):
        for k in range(-r, r + 1):
            at = (to + k) % (2 * side)
            at = at if at < side else 2 * side - 1 - at
            weights[to, at] = weights.get((to, at), 0.0) + raw[k + r] / sum(raw)
    return [(to, at, w) for (to, at), w in sorted(weights.items())]


def blurred(chunks: DataFrame, key: str, edge: int, side: int, sigma: float) -> DataFrame:
    """A separable blur of volumes of one size, mirrored at their edges: one product with the weights along each axis."""
    r = int(4.0 * sigma + 0.5)
    weights = np.zeros((side + 2 * r + edge, side + 2 * r + edge))  # beyond the volume all weights are 0
    for to, at, w in kernel(side, sigma):
        weights[to + r, at + r] = w

    def change(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.nan_to_num(padded)
        for axis in range(3):
            own = places[:, axis] * edge
            table = np.stack([weights[o + r : o + r + edge, o : o + edge + 2 * r] for o in own])  # (chunk, to, at)
            out = np.moveaxis(np.einsum("nta,na...->nt...", table, np.moveaxis(out, axis + 1, 1)), 1, axis + 1)
        return np.where(np.isnan(c.shifted(padded, r, (0, 0, 0))), np.nan, out)

    return c.with_halo(chunks, key, edge, r, change)


def response_mask(chunks: DataFrame, key: str, edge: int, sigma: float) -> DataFrame:
    """Chunks that are 1 where a volume, smoothed twice by a 5-voxel Gaussian with nothing beyond its edges, is below 0."""
    line = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    line = line / (2 * math.pi * sigma * sigma) ** (1 / 3)

    def change(padded: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.nan_to_num(padded)
        for axis in (1, 2, 3):
            out = sum(w * np.take(out, range(k, k + edge), axis) for k, w in enumerate(line))
        return np.where(np.isnan(c.shifted(padded, 2, (0, 0, 0))), np.nan, out)

    twice = c.with_halo(c.with_halo(chunks, key, edge, 2, change), key, edge, 2, change)
    return twice.withColumn("v", F.transform("v", lambda x: F.when(F.isnan(x), x).otherwise((x < 0).cast("double"))))


def blur(samples: DataFrame, side: int, sigma: float) -> DataFrame:
    """A separable blur of each sample's cube, mirrored at its edges."""
    weights = np.zeros((side, side))
    for to, at, w in kernel(side, sigma):
        weights[to, at] = w
    cube = samples.select("*", *[F.lit(0).alias(f"c{a}") for a in AXES])
    change = lambda v, _: np.einsum("az,by,cx,nzyx->nabc", weights, weights, weights, v, optimize=True)
    return c.each(cube, "sample_id", side, change).select("sample_id", "v")


def splice(synthetic: DataFrame, mask: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """Cubes synthetic * w + real * (1 - w), w the mask's value clipped to 0..1. Cubes are joined, not voxels."""
    joined = synthetic.select(key, F.col("v").alias("s")).join(mask.select(key, F.col("v").alias("w")), key).join(real.select(key, F.col("v").alias("r")), key)
    clipped = F.transform("w", lambda w: F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))
    rest = F.zip_with("r", clipped, lambda r, w: r * (1 - w))
    return joined.select(key, F.zip_with(F.zip_with("s", clipped, lambda s, w: s * w), rest, lambda a, b: F.round(a + b, 6)).alias("v"))


def projection(voxels: DataFrame, key: str, axis: str, how: str) -> DataFrame:
    """Sum or maximum along an axis: key, a, b, v with the two other axes as a and b."""
    a, b = [x for x in AXES if x != axis]
    return voxels.groupBy(key, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.round({"sum": F.sum, "max": F.max}[how]("v"), 6).alias("v"))


def projections(voxels: DataFrame, key: str, how: str) -> DataFrame:
    parts = [projection(voxels, key, x, how).withColumn("axis", F.lit(x)) for x in AXES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def central_slices(voxels: DataFrame, key: str, side: int) -> DataFrame:
    """The middle plane of each axis; a voxel where planes cross is in each of them."""
    middle = F.explode(F.filter(F.array(*[F.when(F.col(x) == side // 2, F.lit(x)) for x in AXES]), lambda a: a.isNotNull()))
    return voxels.withColumn("axis", middle).select(key, "axis", "z", "y", "x", F.round("v", 6).alias("v"))


def range_of(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.round(F.array_min("v"), 6).alias("low"), F.round(F.array_max("v"), 6).alias("high"))


CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
CUBE = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def dilate(mask: DataFrame, key: str, edge: int, times: int = 2) -> DataFrame:
    """Chunks of 0 and 1: what is set, and what is next to it by a face, again and again."""
    def change(padded: np.ndarray, _: np.ndarray) -> np.ndarray:
        there, out = ~np.isnan(padded), np.nan_to_num(padded) > 0
        for _ in range(times):
            grown = out.copy()
            for axis in (1, 2, 3):
                ends = [slice(None)] * 4
                for low, high in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                    ends[axis] = low
                    to = tuple(ends)
                    ends[axis] = high
                    grown[to] |= out[tuple(ends)]
            out = grown & there
        inner = c.shifted(out, times, (0, 0, 0)).astype(float)
        return np.where(c.shifted(there, times, (0, 0, 0)), inner, np.nan)

    return c.with_halo(mask, key, edge, times, change)


def neighbour_sum(chunks: DataFrame, key: str, edge: int) -> DataFrame:
    def change(padded: np.ndarray, _: np.ndarray) -> np.ndarray:
        known = np.nan_to_num(padded)
        return np.where(np.isnan(c.shifted(padded, 1, (0, 0, 0))), np.nan, sum(c.shifted(known, 1, o) for o in CUBE))

    return c.with_halo(chunks, key, edge, 1, change)


def local_maxima(chunks: DataFrame, key: str, edge: int) -> DataFrame:
    """Chunks that keep the voxels that no neighbour in the 3x3x3 cube exceeds, NaN elsewhere."""
    def change(padded: np.ndarray, _: np.ndarray) -> np.ndarray:
        own, top = c.shifted(padded, 1, (0, 0, 0)), c.shifted(padded, 1, (0, 0, 0))
        for o in CUBE:
            top = np.fmax(top, c.shifted(padded, 1, o))
        return np.where(own == top, own, np.nan)

    return c.with_halo(chunks, key, edge, 1, change)


def without_idle_decay(cutoff: float, decay: float) -> float:
    """The decay of one side of a filter: none where the side is off."""
    return decay if cutoff else 0.0


def cosine_mask(r: Column, low_pass: Column | float, low_decay: Column | float, high_pass: Column | float, high_decay: Column | float) -> Column:
    """The band-pass weight at distance r: half-cosine edges of the given widths, hard ones for width 0; cutoff 0 lets
    everything pass. Cutoffs and widths are numbers or columns."""
    low_pass, low_decay, high_pass, high_decay = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low_pass, low_decay, high_pass, high_decay))

    def edge(f: Column, d: Column) -> Column:
        slope = 0.5 + 0.5 * F.cos(F.lit(math.pi) * (r - (f - d / 2)) / d)
        return F.when(r <= f - d / 2, 1.0).when(r >= f + d / 2, 0.0).otherwise(slope)

    low = F.when(low_pass == 0, 1.0).when(low_decay == 0, (r <= low_pass).cast("double")).otherwise(edge(low_pass, low_decay))
    high = F.when(high_pass == 0, 1.0).when(high_decay == 0, (r >= high_pass).cast("double")).otherwise(1 - edge(high_pass, high_decay))
    return low * high


def positive_frequencies(n: Column, spacing: float) -> Column:
    """The frequencies of an axis of n voxels from 0 on, in 1 / spacing: 0, 1, ... below n / 2, each over n * spacing."""
    return F.transform(F.sequence(F.lit(0), F.ceil(n / 2).cast("int") - 1), lambda k: k / (n * spacing))


def masked(voxels: DataFrame, key: str, sizes: dict[str, int], low_pass: float = 0, low_decay: float = 0, high_pass: float = 0, high_decay: float = 0) -> DataFrame:
    """key, z, y, x, w, v: voxels under a mask around the place n // 2 of each axis, such as centred spectra are filtered
    with; sizes are those of the axes."""
    low_decay, high_decay = without_idle_decay(low_pass, low_decay), without_idle_decay(high_pass, high_decay)
    r = F.sqrt(sum(((F.col(a) - sizes[a] // 2) * (F.col(a) - sizes[a] // 2) for a in AXES), F.lit(0)).cast("double"))
    w = cosine_mask(r, low_pass, low_decay, high_pass, high_decay)
    return voxels.select(key, *AXES, F.round(w, 6).alias("w"), F.round(w * F.col("v"), 6).alias("v"))


def filter_profiles(jobs: DataFrame, key: str, n: int) -> DataFrame:
    """key, x, w: the weights along an axis of n places through the middle, for each job (key, low_pass, low_decay, high_pass,
    high_decay, in pixels)."""
    along = jobs.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = F.abs(F.col("x") - n // 2).cast("double")
    return along.select(key, "x", F.round(cosine_mask(r, *[F.col(c) for c in ("low_pass", "low_decay", "high_pass", "high_decay")]), 6).alias("w"))


def tta_average(samples: DataFrame, side: int, weights: list[float]) -> DataFrame:
    """A linear predictor's output (each voxel times its weight), averaged over the eight mirrored copies."""
    w = F.array(*[F.lit(x) for x in weights])
    total = None
    for bits in range(8):
        source = [_index([side - 1 - c if bits >> k & 1 else c for k, c in enumerate(p)], side) for p in _places(side)]
        # mirrored back, a voxel has met the weight of the place it was mirrored to
        part = F.transform(F.array(*[F.lit(i) for i in source]), lambda i: F.get(w, i))
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    return samples.select("sample_id", F.zip_with("v", total, lambda x, t: x * t / 8).alias("v"))


def overlap_add(tiles: DataFrame, key: str) -> DataFrame:
    """Weighted mean of overlapping tiles: sum(w * v) / sum(w) at each place."""
    return tiles.groupBy(key, "at").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 6).alias("v"))


def ensemble_argmax(logits: DataFrame, key: str) -> DataFrame:
    """The class of the highest logit averaged over folds; of equals the lowest class."""
    mean = logits.groupBy(key, "cls").agg(F.round(F.avg("logit"), 9).alias("logit"))
    return mean.groupBy(key).agg(F.max_by("cls", F.struct(F.col("logit"), -F.col("cls"))).alias("cls"))
