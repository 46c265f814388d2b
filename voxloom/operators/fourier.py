"""Band-pass filters of whole volumes, however large: a Fourier transform by pencils of chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import chunks as c
from voxloom.operators.kernels import cosine_weights


def in_frequency(chunks: DataFrame, key: str, edge: int, weights: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Chunks after their spectrum was multiplied by weights(r, n): r is the distance from the zero frequency in pixels of the
    spectrum, n the volume's three sizes.

    One axis is transformed after another, and chunks are shuffled in between so that those along the axis meet. As voxels
    are real, half of the frequencies along z do. Along x the way there, the weights and the way back are one pass."""
    def along_x(x: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        k = [np.arange(len(x)), *[s + np.arange(size) for s, size in zip(start, x.shape[1:], strict=True)]]
        k = [np.minimum(k[0], n[2] - k[0]), k[1], np.minimum(k[2], n[1] - k[2])]  # x, z (half a spectrum), y
        r = np.sqrt(sum(a.astype(float) ** 2 for a in np.ix_(*k)))
        return np.fft.ifft(np.fft.fft(x, axis=0) * weights(r, n), axis=0)

    now = c.pencils(c.pieces(chunks, key, edge), key, edge, 0, lambda x, n, _: np.fft.rfft(x, axis=0))
    now = c.pencils(now, key, edge, 1, lambda x, n, _: np.fft.fft(x, axis=0))
    now = c.pencils(now, key, edge, 2, along_x)
    now = c.pencils(now, key, edge, 1, lambda x, n, _: np.fft.ifft(x, axis=0))
    return c.whole_chunks(c.pencils(now, key, edge, 0, lambda x, n, _: np.fft.irfft(x, n[0], axis=0)), key, edge)


def bandpass(chunks: DataFrame, key: str, edge: int, spacing: float, low_pass: float = 0, low_decay: float = 0, high_pass: float = 0, high_decay: float = 0) -> DataFrame:
    """Cutoffs in angstrom, 0 for none; decays in pixels of the spectrum. A cutoff of f lies max(d, h, w) * spacing / f pixels
    from the zero frequency."""
    pixels = lambda f, n: max(n) * spacing / f if f else 0
    return in_frequency(chunks, key, edge, lambda r, n: cosine_weights(r, pixels(low_pass, n), low_decay, pixels(high_pass, n), high_decay))


def log_spectrum(chunks: DataFrame, key: str, edge: int) -> DataFrame:
    """key, z, y, x, v: log(|F| + 1) of each volume's spectrum, whatever its size, the zero frequency at n // 2 of each axis."""
    now = c.pieces(chunks, key, edge)
    for axis in range(3):
        now = c.pencils(now, key, edge, axis, lambda x, n, _: np.fft.fft(x, axis=0))
    value = F.zip_with("re", "im", lambda re, im: F.log1p(F.sqrt(re * re + im * im)))
    rows = now.select(key, *c.PIECE, F.posexplode(value).alias("i", "v"))
    within = dict(z=F.floor(F.col("i") / (F.col("h") * F.col("w"))), y=F.floor(F.col("i") / F.col("w")) % F.col("h"), x=F.col("i") % F.col("w"))
    place = lambda a: (F.col(f"c{a}") * edge + within[a] + F.floor(F.col(f"n{a}") / 2)) % F.col(f"n{a}")
    return rows.select(key, *[place(a).cast("int").alias(a) for a in "zyx"], "v")


def filter_tomograms(jobs: DataFrame, volumes: DataFrame, edge: int, spacing: float, low_pass: float = 0, low_decay: float = 0, high_pass: float = 0, high_decay: float = 0) -> tuple[DataFrame, DataFrame]:
    """A filter job over runs: the filtered volumes as chunks with the name they are stored under, and a row for each job
    with its volume's sizes or why it did nothing. jobs: run, tomo_type, given (a name to store under, or null).

    The second table needs no Fourier work. Runs without a volume, or with one that lacks voxels, don't stop the others;
    cutoffs that make no filter are an error of the whole job."""
    spark = jobs.sparkSession
    cutoffs = [F.lit(float(x)) for x in (spacing, low_pass, high_pass)]
    problem = spark.range(1).select(text.filter_problem(*cutoffs)).first()[0]
    if problem:
        raise ValueError(problem)
    found = jobs.join(c.extents(volumes, "run", edge), "run", "left")
    error = F.when(F.col("whole").isNull(), "no volume").when(~F.col("whole"), "voxels are missing")
    name = text.output_name(F.col("tomo_type"), *cutoffs[1:], F.col("given"))
    of = lambda x: F.when(error.isNull(), F.col(x)).alias(x)
    table = found.select("run", name.alias("name"), of("d"), of("h"), of("w"), of("voxels"), error.alias("error"))
    there = table.where("error IS NULL").select("run", "name")
    done = bandpass(volumes.join(there.select("run"), "run", "left_semi"), "run", edge, spacing, low_pass, low_decay, high_pass, high_decay)
    return done.join(there, "run"), table
