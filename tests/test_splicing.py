"""Spliced sub-volumes against numpy on whole volumes."""

import numpy as np

from test_fourier import as_chunks
from voxloom.functions import rng
from voxloom.operators import chunks, splicing

EDGE, BOX = 4, 6


def test_blending_as_a_mask_or_with_smooth_edges():
    one, zero, mask = np.ones((16, 16, 16)), np.zeros((16, 16, 16)), np.zeros((16, 16, 16), bool)
    mask[4:12, 4:12, 4:12] = True
    hard, soft = splicing.blend(one, mask, zero, 0.0), splicing.blend(one, mask, zero, 2.0)
    assert (hard[mask] == 1).all() and (hard[~mask] == 0).all()
    assert (soft[7:9, 7:9, 7:9] > 0.7).all() and (soft[:2, :2, :2] < 0.1).all()
    assert ((soft[3:5, 8, 8] > 0.1) & (soft[3:5, 8, 8] < 0.9)).any()
    assert (np.diff(soft[8, 8, 8:]) <= 0).mean() >= 0.8
    assert not np.array_equal(hard, soft) and (soft > 0.01).sum() > mask.sum()


def test_boxes_cut_out_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(splicing, "AT_ONCE", 3)  # several lists of boxes go to a chunk
    r = np.random.default_rng(1)
    volumes = {i: r.normal(size=s).astype(np.float32) for i, s in enumerate([(9, 8, 13), (4, 4, 4)])}
    wanted = [(i, int(i % 2), *map(int, r.integers(-3, 9, 3)), *map(int, r.integers(1, 8, 3))) for i in range(40)] + [(99, 5, 0, 0, 0, 2, 2, 2)]
    boxes = spark.createDataFrame(wanted, "id long, run long, z int, y int, x int, d int, h int, w int")
    got = {}
    for x in splicing.cut_boxes(boxes, as_chunks(spark, volumes, EDGE), "run", EDGE).collect():
        got.setdefault(x.id, []).append((*x.part[:6], np.array(x.part.v)))
    for i, run, z, y, x, d, h, w in wanted:
        want = np.full((d, h, w), np.nan)
        if run in volumes:
            at = np.argwhere(np.ones((d, h, w), bool)) + [z, y, x]
            inside = ((at >= 0) & (at < volumes[run].shape)).all(1)
            want.reshape(-1)[inside] = volumes[run][tuple(at[inside].T)]
        assert np.array_equal(splicing.filled(got.get(i, []), (d, h, w)), want, equal_nan=True)


def test_spliced_cubes(spark):
    r = np.random.default_rng(2)
    labels = np.zeros((10, 12, 9), np.float32)
    labels[1:4, 2:5, 0:3], labels[6:10, 8:12, 5:9], labels[5, 5, 5] = 1, 2, 3
    made = {i: r.normal(size=s).astype(np.float32) for i, s in {0: (10, 12, 9), 1: (7, 9, 8), 2: (5, 5, 5), 3: (6, 6, 6)}.items()}
    label_chunks = as_chunks(spark, {0: labels, 2: np.ones((5, 5, 5), np.float32)}, EDGE)
    real = as_chunks(spark, made, EDGE)
    stats = splicing.component_stats(label_chunks, "run", EDGE)
    assert {(x.run, x.component): (x.area, x.cz, x.cy, x.cx) for x in stats.collect()} == {(0, 1): (27, 2.0, 3.0, 1.0), (0, 2): (64, 7.5, 9.5, 6.5), (0, 3): (1, 5.0, 5.0, 5.0), (2, 1): (125, 2.0, 2.0, 2.0)}
    draws = [(0, "background", None, None, 1), (1, "background", None, None, 2), (2, "spliced", 0, 1, 1), (3, "spliced", 0, 2, 0), (4, "spliced", 0, 3, 3), (5, "spliced", 2, 1, 1), (6, "spliced", 0, 2, 1)]
    draws = spark.createDataFrame(draws, "draw long, kind string, component_run long, component long, run long")
    for sigma in (0.0, 1.5):
        got = {x.draw: np.reshape(x.v, (BOX,) * 3) for x in splicing.spliced_samples(draws, stats, label_chunks, real, real, EDGE, BOX, sigma).collect()}
        assert set(got) == {0, 1, 2, 3, 4, 6}  # volume 2 is smaller than the box
        crop = {}
        for x in spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 1, 0, 3, 1, 1])], "id long, run long").select("id", "run", *[rng.uniform(f"splice-crop-{a}", "id").alias(a) for a in "zyx"]).collect():
            shape = made[x.run].shape
            at = [int(x[a] * (n - BOX + 1)) for a, n in zip("zyx", shape, strict=True)]
            if min(shape) > BOX:
                crop[x.id] = made[x.run][tuple(slice(a, a + BOX) for a in at)]
            else:
                weights = [chunks.resize_weights(n, BOX) for n in shape]
                crop[x.id] = np.einsum("az,by,cx,zyx->abc", *weights, made[x.run].astype(float))
        for i, x in got.items():
            want = crop[i]
            if i > 1:
                component = {2: 1, 3: 2, 4: 3, 6: 2}[i]
                mask = splicing.grown(labels == component, np.ones(labels.shape, bool))
                centre = np.argwhere(labels == component).mean(0)
                low = [min(max(0, int(m - BOX // 2)), n - BOX) for m, n in zip(centre, labels.shape, strict=True)]
                box = tuple(slice(a, a + BOX) for a in low)
                want = splicing.blend(made[0][box].astype(float), mask[box], want.astype(float), sigma)
            assert np.allclose(x, want, atol=1e-6), i
