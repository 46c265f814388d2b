"""Watershed by flooding against a flood of the whole volume by a heap."""

import heapq

import numpy as np
import pytest

from voxloom.operators import flooding

SCHEMA = "run long, cz int, cy int, cx int, v array<double>, m array<double>"


def by_heap(v, m, least):
    """Links are taken in order; the first that reaches a voxel floods it."""
    height = lambda p: (-v[p], p)
    label, links = np.where((v > least) & (m > 0), m, 0), []

    def around(p):
        for axis in range(3):
            for step in (-1, 1):
                q = tuple(c + step * (k == axis) for k, c in enumerate(p))
                if all(0 <= c < n for c, n in zip(q, v.shape, strict=True)) and v[q] > least and not label[q]:
                    heapq.heappush(links, (*sorted((height(p), height(q)), reverse=True), p, q))

    for p in zip(*map(np.ndarray.tolist, np.nonzero(label)), strict=True):
        around(p)
    while links:
        *_, p, q = heapq.heappop(links)
        if not label[q]:
            label[q] = label[p]
            around(q)
    return label


def cut(spark, volumes, edge):
    rows = []
    for run, (v, m) in volumes.items():
        n = [-(-s // edge) for s in v.shape]
        full = [np.full([k * edge for k in n], np.nan) for _ in range(2)]
        for f, a in zip(full, (v, m), strict=True):
            f[tuple(slice(0, s) for s in a.shape)] = a
        for at in np.ndindex(*n):
            box = tuple(slice(k * edge, (k + 1) * edge) for k in at)
            rows.append((run, *at, *[f[box].ravel().tolist() for f in full]))
    return spark.createDataFrame(rows, SCHEMA).repartition(8)


def labels(df, shape, edge):
    got = {}
    for r in df.collect():
        a = got.setdefault(r.run, np.full([-(-s // edge) * edge for s in shape[r.run]], np.nan))
        a[tuple(slice(k * edge, (k + 1) * edge) for k in (r.cz, r.cy, r.cx))] = np.reshape(r.v, (edge,) * 3)
    return {k: a[tuple(slice(0, s) for s in shape[k])] for k, a in got.items()}


@pytest.mark.parametrize("levels", [3, 12, 10**6])
def test_floods_of_many_chunks(spark, levels):
    """Few levels make plateaus and ties; some voxels lie below the level, and markers are of several voxels."""
    r, volumes = np.random.default_rng(levels), {}
    for run, shape in enumerate([(13, 8, 11), (4, 4, 4), (16, 16, 16), (2, 3, 9)]):
        v = np.floor(r.random(shape) * levels) / levels
        volumes[run] = (v, np.where(r.random(shape) < 0.02, r.integers(1, 6, shape), 0).astype(float))
    volumes[9] = (np.ones((8, 8, 8)), np.zeros((8, 8, 8)))
    found = labels(flooding.flooded(cut(spark, volumes, 4), "run", 4, 0.2), {k: v.shape for k, (v, _) in volumes.items()}, 4)
    assert set(found) == set(volumes)
    for k, (v, m) in volumes.items():
        assert np.array_equal(found[k], by_heap(v, m, 0.2)), k


def test_a_larger_volume_and_none(spark):
    r = np.random.default_rng(1)
    v = np.round(sum(np.roll(r.random((32, 32, 32)), s, a) for s in range(3) for a in range(3)) / 3, 1)
    m = np.zeros(v.shape)
    for i, p in enumerate(r.integers(0, 32, (40, 3))):
        m[tuple(p)] = i + 1
    df = cut(spark, {0: (v, m)}, 8)
    assert np.array_equal(labels(flooding.flooded(df, "run", 8, 0.9), {0: v.shape}, 8)[0], by_heap(v, m, 0.9))
    assert flooding.flooded(df.limit(0), "run", 8, 0.9).count() == 0
