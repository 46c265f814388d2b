"""Filters of whole volumes against numpy's transform of the whole."""

import numpy as np
import pytest

from voxloom.operators import chunks, fourier, jobs, kernels

SCHEMA = "run long, cz int, cy int, cx int, v array<float>"


def as_chunks(spark, volumes, edge, without=()):
    rows = []
    for run, a in volumes.items():
        n = [-(-s // edge) for s in a.shape]
        padded = np.full([k * edge for k in n], np.nan, np.float32)
        padded[tuple(slice(0, s) for s in a.shape)] = a
        for at in np.ndindex(*n):
            if (run, at) not in without:
                part = padded[tuple(slice(c * edge, (c + 1) * edge) for c in at)]
                rows.append((run, *at, part.ravel().tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def as_volume(rows, edge):
    n = [max(r[c] for r in rows) + 1 for c in ("cz", "cy", "cx")]
    out = np.full([k * edge for k in n], np.nan)
    for r in rows:
        out[tuple(slice(r[c] * edge, (r[c] + 1) * edge) for c in ("cz", "cy", "cx"))] = np.reshape(r.v, (edge,) * 3)
    keep = [np.flatnonzero(~np.isnan(out).all(axis=tuple(k for k in range(3) if k != axis))) for axis in range(3)]
    return out[np.ix_(*keep)]


def by_numpy(a, spacing, low_pass=0, low_decay=0, high_pass=0, high_decay=0):
    pixels = [max(a.shape) * spacing / f if f else 0 for f in (low_pass, high_pass)]
    w = kernels.mask(a.shape, pixels[0], low_decay, pixels[1], high_decay)
    return np.fft.ifftn(np.fft.fftn(a) * np.fft.ifftshift(w)).real


@pytest.mark.parametrize("cutoffs", [{"low_pass": 40.0, "low_decay": 2.0}, {"high_pass": 90.0, "high_decay": 3.0}, {"low_pass": 30.0, "high_pass": 80.0}])
def test_bandpass_of_volumes_of_any_size(spark, cutoffs):
    r = np.random.default_rng(1)
    volumes = {i: r.normal(size=s).astype(np.float32) for i, s in enumerate([(7, 12, 9), (8, 8, 8), (5, 3, 16), (1, 1, 4), (13, 1, 2)])}
    found = fourier.bandpass(as_chunks(spark, volumes, 4), "run", 4, 10.0, **cutoffs).collect()
    for i, a in volumes.items():
        got = as_volume([x for x in found if x.run == i], 4)
        assert got.shape == a.shape and np.allclose(got, by_numpy(a.astype(float), 10.0, **cutoffs), atol=1e-6)


def test_bandpass_of_a_large_volume(spark):
    a = np.random.default_rng(2).normal(size=(128, 128, 128)).astype(np.float32)
    cutoffs = {"low_pass": 45.0, "low_decay": 4.0, "high_pass": 400.0, "high_decay": 1.0}
    found = fourier.bandpass(as_chunks(spark, {0: a}, 32), "run", 32, 10.0, **cutoffs).collect()
    assert len(found) == 64 and np.allclose(as_volume(found, 32), by_numpy(a.astype(float), 10.0, **cutoffs), atol=1e-6)


def test_job_reports_by_run_and_goes_on(spark):
    r = np.random.default_rng(3)
    volumes = {1: r.normal(size=(8, 4, 6)), 2: r.normal(size=(8, 8, 8)), 3: r.normal(size=(4, 4, 4))}
    hole = volumes[3].copy()
    hole[1, 1, 1] = np.nan
    given = as_chunks(spark, volumes | {3: hole}, 4, without={(2, (1, 0, 1))})
    wanted = spark.createDataFrame([(1, "wbp", None), (1, "wbp", "own"), (2, "wbp", None), (3, "wbp", None), (4, "wbp", None)], "run long, tomo_type string, given string")
    done, table = fourier.filter_tomograms(wanted.where("given IS NULL"), given, 4, 10.0, low_pass=40.0, high_pass=150.0)
    assert {(x.run, x["name"], x.d, x.h, x.w, x.voxels, x.error) for x in table.collect()} == {
        (1, "wbp-lp40A-hp150A", 8, 4, 6, 192, None), (2, "wbp-lp40A-hp150A", None, None, None, None, "voxels are missing"),
        (3, "wbp-lp40A-hp150A", None, None, None, None, "voxels are missing"), (4, "wbp-lp40A-hp150A", None, None, None, None, "no volume"),
    }
    assert {(x.run, x["name"]) for x in done.collect()} == {(1, "wbp-lp40A-hp150A")}
    assert {x["name"] for x in fourier.filter_tomograms(wanted, given, 4, 10.0, low_pass=40.0)[1].where("run = 1").collect()} == {"own", "wbp-lp40A"}
    for bad in ({}, {"low_pass": 15.0}, {"low_pass": 80.0, "high_pass": 60.0}):
        with pytest.raises(ValueError):
            fourier.filter_tomograms(wanted, given, 4, 10.0, **bad)
    assert fourier.filter_tomograms(wanted, given.limit(0), 4, 10.0, low_pass=40.0)[0].count() == 0


def test_downsampling_job_does_no_fourier_work_for_its_table(spark):
    volumes = as_chunks(spark, {1: np.zeros((8, 8, 8))}, 4)
    table = jobs.filter_volumes(spark.createDataFrame([(1, "a"), (2, "b")], "run long, name string"), volumes, 4, 10.0, 20.0)[1]
    assert {tuple(x) for x in table.collect()} == {(1, "a", 4, 4, 4, 64, None), (2, "b", None, None, None, None, "no volume")}
    assert table._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_no_task_holds_a_volume(spark):
    """Parts that meet are those of one pencil of chunks."""
    parts = chunks.pieces(as_chunks(spark, {0: np.ones((16, 12, 8), np.float32)}, 4), "run", 4)
    seen = chunks.pencils(parts, "run", 4, 0, lambda x, n, start: x * 0 + x.size)
    assert {v for r in seen.select("re").collect() for v in r.re} == {16 * 4 * 4}


def test_spectra_of_volumes_of_any_size(spark):
    volumes = {1: np.random.default_rng(3).normal(size=(9, 6, 11)), 2: np.random.default_rng(4).normal(size=(4, 8, 5)), 3: np.zeros((2, 2, 2))}
    got = {k: np.full(a.shape, np.nan) for k, a in volumes.items()}
    for r in fourier.log_spectrum(as_chunks(spark, volumes, 4), "run", 4).collect():
        got[r.run][r.z, r.y, r.x] = r.v
    for k, a in volumes.items():
        assert np.allclose(got[k], np.log(np.abs(np.fft.fftshift(np.fft.fftn(a.astype(np.float32)))) + 1), atol=1e-6)
