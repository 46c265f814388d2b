"""Augmentation of whole samples behind gates: each one's draws are hashes of a seed and the sample's id.

Gates are evaluated in the row, so a chain reads its input once, whatever its length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rng
from voxloom.functions.let import let
from voxloom.operators import kernels, volume

#: What a chain applies, in this order, each with its probability. Fixed values.
CHAIN = {"brightness": 0.3, "blur": 0.2, "intensity": 0.2, "flip": 0.2, "rotate": 0.2, "fourier": 0.3}
AXES = ("z", "y", "x")
PLANES = (("z", "y"), ("z", "x"), ("y", "x"))


def gate(seed: str, name: str, probability: float) -> Column:
    return rng.uniform(f"{seed}-{name}", "sample_id") < probability


#: Pairs that are drawn for a fractional shape. Each is accepted with a probability of 0.78 or more, so that none is has one
#: below 1e-15; such a draw is null.
PAIRS = 24


def _gamma(seed: str, alpha: float, *keys: Column | str) -> Column:
    """A draw of Gamma(alpha): an exponential draw for each whole one, and for the rest r an exponential draw times a draw
    of Beta(r, 1 - r), the first share u^(1/r) / (u^(1/r) + w^(1/(1-r))) of which the sum is at most 1."""
    whole, rest = int(alpha), alpha - int(alpha)
    positive = lambda name: 1.0 - rng.uniform(f"{seed}-{name}", *keys)
    out = sum((-F.log(positive(f"e{k}")) for k in range(whole)), F.lit(0.0))
    if not rest:
        return out
    pairs = F.array(*[F.struct(F.pow(positive(f"u{k}"), F.lit(1 / rest)).alias("u"), F.pow(positive(f"w{k}"), F.lit(1 / (1 - rest))).alias("w")) for k in range(PAIRS)])
    first = F.get(F.filter(pairs, lambda x: (x["u"] + x["w"] <= 1) & (x["u"] + x["w"] > 0)), F.lit(0))
    return out - F.log(positive("rest")) * first["u"] / (first["u"] + first["w"])


def beta(seed: str, alpha: float, *keys: Column | str) -> Column:
    """A draw of Beta(alpha, alpha). For a whole alpha the median-like order statistic number alpha of 2 * alpha - 1 uniform
    draws, which has just that distribution; else the share of one of two draws of Gamma(alpha)."""
    if not alpha > 0:
        raise ValueError("alpha must be above 0")
    if alpha != int(alpha):
        g, h = _gamma(f"{seed}-g", alpha, *keys), _gamma(f"{seed}-h", alpha, *keys)
        return g / (g + h)
    alpha = int(alpha)
    draws = F.array(*[rng.uniform(f"{seed}-{k}", *keys) for k in range(2 * alpha - 1)])
    return F.element_at(F.sort_array(draws), alpha)


def blur_weights(side: int, sigma: float) -> np.ndarray:
    out = np.zeros((side, side))
    for to, at, w in volume.kernel(side, sigma):
        out[to, at] = w
    return out


def pipeline(samples: DataFrame, side: int, fourier: tuple[float, float, tuple[float, float]], chain: dict[str, float] = CHAIN, seed: str = "chain") -> DataFrame:
    """sample_id and v after the chain: brightness by -0.5..0.5, blur of sigma 0.5..1.5, intensity times 0.5..1.5, a flip of
    one axis, one to three quarter turns in a plane, and the Fourier kernel; each behind its gate.

    Blur and Fourier run in numpy, in one pass over Arrow batches each; the others are array expressions. Draws are made
    before the Arrow pass, so they agree whatever the partitioning."""
    unknown = set(chain) - set(CHAIN)
    if unknown:
        raise ValueError(f"unknown augmentations {sorted(unknown)}")
    draw = lambda name: rng.uniform(f"{seed}-{name}-by", "sample_id")
    on = {name: gate(seed, name, chain.get(name, 0.0)) for name in CHAIN}
    df = samples.select("sample_id", F.when(on["brightness"], let(draw("brightness") - 0.5, lambda by: F.transform("v", lambda x: x + by))).otherwise(F.col("v")).alias("v"))
    df = _blurred(df.withColumn("sigma", F.when(on["blur"], draw("blur") + 0.5)), side)
    df = df.withColumn("v", F.when(on["intensity"], let(draw("intensity") + 0.5, lambda by: F.transform("v", lambda x: x * by))).otherwise(F.col("v")))
    choose = lambda name, options: _chosen(df, on[name], F.floor(draw(name) * len(options)).cast("int"), options)
    df = choose("flip", [lambda x, a=a: volume.flip(x, a, side) for a in AXES])
    df = choose("rotate", [lambda x, k=k, p=p: volume.rot90(x, k, p, side) for p in PLANES for k in (1, 2, 3)])
    drop, noise, scale = fourier
    return kernels.fourier_augment(df, side, drop, noise, scale, seed=7, only=on["fourier"])


def _chosen(df: DataFrame, on: Column, which: Column, options: list) -> DataFrame:
    """v after the option that was drawn, where the gate is open."""
    tried = df.withColumn("_which", F.when(on, which))
    for i, change in enumerate(options):
        tried = tried.withColumn("_was", F.col("v"))
        tried = change(tried).withColumn("v", F.when(F.col("_which") == i, F.col("v")).otherwise(F.col("_was"))).drop("_was")
    return tried.drop("_which")


def _blurred(df: DataFrame, side: int) -> DataFrame:
    """v blurred by the row's own sigma; as it is where that is null."""
    def run(batches):
        for batch in batches:
            out = []
            for v, sigma in zip(batch.column("v"), batch.column("sigma").to_pylist(), strict=True):
                cube = np.asarray(v.values)
                if sigma is not None:
                    w = blur_weights(side, sigma)
                    cube = np.einsum("az,by,cx,zyx->abc", w, w, w, cube.reshape(side, side, side), optimize=True).ravel()
                out.append(cube)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(out, pa.list_(pa.float64()))], ["sample_id", "v"])

    return df.select("sample_id", "v", "sigma").mapInArrow(run, "sample_id long, v array<double>")
