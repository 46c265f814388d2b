"""Sliding-window inference against plain loops over whole volumes."""

from itertools import product

import duckdb
import numpy as np
import pytest

import compare
from test_fourier import as_chunks, as_volume
from voxloom.operators import sliding
from voxloom.plans import registry

EDGE = 4


def plainly(a, window, overlap, predict, mirrors):
    """Each mirrored copy of the volume is padded, predicted window by window, and mirrored back."""
    total, weights = np.zeros(a.shape), sliding.importance(window)
    for m in range(mirrors):
        axes = [i for i in range(3) if m >> i & 1]
        x = np.flip(a, axes)
        before = [max(0, window - n) // 2 for n in a.shape]
        padded = np.pad(x, [(b, max(0, window - n) - b) for b, n in zip(before, a.shape, strict=True)])
        step = max(1, int(window * (1 - overlap)))
        num, den = np.zeros(padded.shape), np.zeros(padded.shape)
        places = []
        for n in padded.shape:
            k = 0
            own = []
            while True:
                own.append(min(k * step, n - window))
                if k * step + window >= n:
                    break
                k += 1
            places.append(own)
        for at in product(*places):
            box = tuple(slice(s, s + window) for s in at)
            num[box] += predict(padded[box][None])[0] * weights
            den[box] += weights
        out = (num / den)[tuple(slice(b, b + n) for b, n in zip(before, a.shape, strict=True))]
        total += np.flip(out, axes)
    return total / mirrors


def maker():
    def make():
        r = np.random.default_rng(5)
        w, shift = r.normal(size=(6, 6, 6)), r.normal(size=(6, 6, 6))
        return lambda cubes: np.tanh(cubes * w + np.roll(cubes, 1, 2) * shift) + shift

    return make  # goes to the workers by value


@pytest.mark.parametrize("mirrored,overlap", [(True, 0.5), (False, 0.5), (True, 0.2)])
def test_windows_of_mirrored_copies(spark, mirrored, overlap):
    r = np.random.default_rng(1)
    volumes = {i: r.normal(size=s).astype(np.float32) for i, s in enumerate([(13, 10, 7), (6, 12, 9), (3, 5, 11), (1, 1, 1)])}
    given = as_chunks(spark, volumes | {9: volumes[0]}, EDGE, without={(9, (1, 1, 1))})
    found = sliding.predicted(given, "run", EDGE, 6, maker(), overlap, mirrored).collect()
    assert {x.run for x in found} == set(volumes)
    for i, a in volumes.items():
        want = plainly(a.astype(float), 6, overlap, maker()(), 8 if mirrored else 1)
        assert np.allclose(as_volume([x for x in found if x.run == i], EDGE), want, atol=1e-9), i


def test_starts_and_weights():
    assert sliding.starts(10, 6, 0.5) == [0, 3, 4] and sliding.starts(12, 6, 0.5) == [0, 3, 6] and sliding.starts(6, 6, 0.5) == [0] and sliding.starts(3, 6, 0.5) == [-1]
    w = sliding.importance(8)
    assert np.isclose(w.max(), np.exp(-0.75 / 2)) and w.min() == 1e-3 and np.allclose(w, w[::-1, ::-1, ::-1])


def test_a_worker_makes_the_predictor_once(spark, tmp_path):
    def make():
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        return lambda cubes: cubes

    a = np.random.default_rng(2).normal(size=(16, 16, 16)).astype(np.float32)
    found = sliding.predicted(as_chunks(spark, {i: a for i in range(6)}, EDGE), "run", EDGE, 6, make)
    rows = found.collect()
    assert np.allclose(as_volume([x for x in rows if x.run == 3], EDGE), a, atol=1e-6)
    assert 1 <= len(list(tmp_path.iterdir())) <= 8  # not 6 * 125 tiles, nor each task
    cut = sliding.segmented(found, 0.5).where("run = 0").collect()
    assert np.array_equal(as_volume(cut, EDGE) > 0, a > 0.5)


def test_moments_of_chunks(spark):
    r = np.random.default_rng(3)
    volumes = {0: (1e6 + r.normal(size=(9, 5, 6))).astype(np.float32), 1: np.ones((4, 4, 4), np.float32)}
    got = {x.run: x for x in sliding.moments(as_chunks(spark, volumes, EDGE), "run", EDGE).collect()}
    for i, a in volumes.items():
        assert got[i].n == a.size and np.isclose(got[i]["mean"], a.astype(float).mean()) and np.isclose(got[i].sd, a.astype(float).std(), rtol=1e-9)
    whole = as_volume([x for x in sliding.normalised(as_chunks(spark, volumes, EDGE), "run", EDGE).collect() if x.run == 0], EDGE)
    assert np.allclose(whole, (volumes[0].astype(float) - volumes[0].astype(float).mean()) / volumes[0].astype(float).std())


@pytest.mark.parametrize("n", [13, 14, 16])
def test_last_volume_smaller_than_the_window(spark, tmp_path, n):
    """Tables whose last volume has one, two or four chunks, so axes of 4 voxels for a window of 6."""
    rows = [(i, 0, [float((i * 64 + k) * 37 % 101) for k in range(64)]) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["segment_tomograms"])
    names = [c[0] for c in want.description]
    got = registry.QUERIES["segment_tomograms"](spark, f"file://{tmp_path}")
    assert got.count() == n * 64 and compare.rows(got.columns, got.collect()) == compare.rows(names, want.fetchall())


def test_where_small_volumes_lie():
    assert sliding.starts(4, 6, 0.5) == [-1] and sliding.starts(4, 6, 0.5, True) == [-2] and sliding.starts(8, 6, 0.5, True) == [0, 2]
