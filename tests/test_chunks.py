"""Dense operators by chunks and halos against numpy, on volumes of many chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import augment, catalog, chunks, dataset, jobs, kernels, spatial, volume
from voxloom.sources import storage

SCHEMA = "run long, cz int, cy int, cx int, v array<double>"


def cut_up(spark, a, edge, run=0):
    n = [s // edge for s in a.shape]
    rows = [(run, z, y, x, a[z * edge : (z + 1) * edge, y * edge : (y + 1) * edge, x * edge : (x + 1) * edge].ravel().tolist()) for z in range(n[0]) for y in range(n[1]) for x in range(n[2])]
    return spark.createDataFrame(rows, SCHEMA).repartition(8)


def whole(df, edge, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.cz * edge : (r.cz + 1) * edge, r.cy * edge : (r.cy + 1) * edge, r.cx * edge : (r.cx + 1) * edge] = np.reshape(r.v, (edge,) * 3)
    return out


def around(a, width):
    p = np.pad(a, width, constant_values=np.nan)
    return lambda o: p[tuple(slice(width + c, width + c + n) for c, n in zip(o, a.shape, strict=True))]


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).normal(size=(24, 16, 32))


def test_neighbourhoods(spark, noise):
    df, at = cut_up(spark, noise, 8), around(noise, 2)
    box = np.stack([at(o) for o in volume.CUBE])
    assert np.allclose(whole(volume.neighbour_sum(df, "run", 8), 8, noise.shape), np.nansum(box, 0))
    assert np.array_equal(whole(volume.local_maxima(df, "run", 8), 8, noise.shape), np.where(noise == np.nanmax(box, 0), noise, np.nan), equal_nan=True)
    ball = np.stack([at(o) for o in dataset.ball(2)])
    assert np.array_equal(whole(dataset.morphed(df, "run", 8, 2, "erode"), 8, noise.shape), np.nanmin(ball, 0))
    set_ = (noise > 2).astype(float)
    for _ in range(2):
        grown = around(set_, 1)
        set_ = np.nanmax(np.stack([grown(o) for o in volume.CROSS]), 0)
    seeds = df.withColumn("v", F.transform("v", lambda x: (x > 2).cast("double")))
    assert np.array_equal(whole(volume.dilate(seeds, "run", 8), 8, noise.shape), set_)


def test_blur_reaches_over_several_chunks(spark):
    a = np.random.default_rng(5).normal(size=(16, 16, 16))
    w = augment.blur_weights(16, 1.5)
    want = np.einsum("az,by,cx,zyx->abc", w, w, w, a)
    assert np.allclose(whole(volume.blurred(cut_up(spark, a, 4), "run", 4, 16, 1.5), 4, a.shape), want)


def flood(set_):
    labels, n = np.zeros(set_.shape, int), 0
    for p in map(tuple, np.argwhere(set_)):
        if labels[p]:
            continue
        n += 1
        labels[p], todo = n, [p]
        while todo:
            q = todo.pop()
            near = tuple(slice(max(0, c - 1), c + 2) for c in q)
            for r in np.argwhere(set_[near] & (labels[near] == 0)):
                r = tuple(int(k) + max(0, c - 1) for k, c in zip(r, q, strict=True))
                labels[r] = n
                todo.append(r)
    return labels


@pytest.mark.parametrize("share", [0.05, 0.1, 0.3])
def test_components_are_numbered_by_their_first_voxel(spark, share):
    set_ = np.random.default_rng(6).random((24, 16, 32)) < share
    assert np.array_equal(whole(chunks.components(cut_up(spark, set_.astype(float), 8), "run", 8), 8, set_.shape), flood(set_))


def test_components_of_a_large_volume(spark):
    """128^3 voxels in 8^3 chunks: a winding tube through all layers, and blocks beside it."""
    a = np.zeros((128, 128, 128))
    for z in range(0, 128, 4):
        a[z, 0:100, 4] = 1
        a[z : z + 5, (99 if z % 8 == 0 else 0), 4] = 1
    a[10:20, 110:120, 100:128], a[100:128, 110:120, 100:128] = 1, 1
    got = whole(chunks.components(cut_up(spark, a, 8), "run", 8), 8, a.shape)
    assert got.max() == 3 and np.array_equal(got > 0, a > 0)
    assert {len(np.unique(got[s])) for s in (np.s_[10:20, 110:120, 100:128], np.s_[100:128, 110:120, 100:128])} == {1}
    assert set(np.unique(got[:, :100, 4])) == {0, 1}


def test_watershed_by_steepest_ascent(spark):
    a = np.random.default_rng(7).normal(size=(16, 16, 24))
    place = lambda p: ((int(p[0]) << 2 * chunks.BITS) | (int(p[1]) << chunks.BITS) | int(p[2])) + 1
    want = np.zeros(a.shape)
    for p in map(tuple, np.argwhere(a > 0.1)):
        q = p
        while True:
            near = [
                (a[r], tuple(-c for c in r)) for o in volume.CUBE for r in [tuple(c + d for c, d in zip(q, o))] if all(0 <= c < n for c, n in zip(r, a.shape))]
            best = tuple(-c for c in max(near)[1])
            if best == q:
                break
            q = best
        want[p] = place(q)
    assert np.array_equal(whole(chunks.basins(cut_up(spark, a, 4), "run", 4, 0.1), 4, a.shape), want)


def test_rescaling_and_resizing(spark, noise):
    def dense(df, shape):
        out = np.full(shape, np.nan)
        for r in df.collect():
            out[r.z, r.y, r.x] = r.v
        return out

    spectrum = np.fft.fftshift(np.fft.fftn(noise, norm="ortho"))
    size = [int(round(n * 10 / 15.0)) // 2 * 2 for n in noise.shape]
    kept = spectrum[tuple(slice(n // 2 - m // 2, n // 2 - m // 2 + m) for n, m in zip(noise.shape, size, strict=True))]
    want = np.fft.ifftn(np.fft.ifftshift(kept), norm="ortho").real
    df = cut_up(spark, noise, 8)
    assert np.allclose(dense(chunks.rescaled(df, "run", 8, 10.0, 15.0), want.shape), want)
    with pytest.raises(ValueError):
        chunks.rescaled(df, "run", 8, 10.0, 5.0)
    assert np.allclose(chunks.resize_weights(9, 9), np.eye(9)) and np.allclose(chunks.resize_weights(24, 7).sum(1), 1) and np.allclose(chunks.resize_weights(5, 12).sum(1), 1)
    r = [chunks.resize_weights(n, 7) for n in noise.shape]
    assert np.allclose(dense(chunks.resized(df, "run", 8, 7), (7, 7, 7)), np.einsum("az,by,cx,zyx->abc", *r, noise))


def test_boxes_are_put_together(spark):
    a = np.random.default_rng(8).normal(size=(32, 32, 32))
    points = spark.createDataFrame([(1, 0, 16.0, 9.0, 20.0), (2, 0, 2.0, 30.0, 16.0)], "point_id long, run long, x double, y double, z double")
    placed = spatial.boxes(points, 12, 32)
    got = {r.point_id: np.reshape(r.v, (12,) * 3) for r in spatial.assembled(spatial.pieces(placed, cut_up(spark, a, 8), 8), 12).collect()}
    assert np.array_equal(got[1], a[14:26, 3:15, 10:22])
    want = np.zeros((12, 12, 12))
    want[:, :8, 4:] = a[10:22, 24:32, 0:8]
    assert np.array_equal(got[2], want)


def test_augmentation_chain(spark):
    cubes = np.random.default_rng(9).normal(size=(60, 4, 4, 4))
    df = spark.createDataFrame([(i, c.ravel().tolist()) for i, c in enumerate(cubes)], "sample_id long, v array<double>")
    fourier = (0.3, 0.1, (0.8, 1.2))
    off = {r.sample_id: r.v for r in augment.pipeline(df, 4, fourier, {}).collect()}
    assert all(np.array_equal(off[i], c.ravel()) for i, c in enumerate(cubes))
    gates = {n: {r.sample_id for r in df.where(augment.gate("chain", n, 0.5)).select("sample_id").collect()} for n in augment.CHAIN}
    for name in augment.CHAIN:
        got = {r.sample_id: np.array(r.v) for r in augment.pipeline(df, 4, fourier, {name: 0.5}).collect()}
        changed = {i for i, c in enumerate(cubes) if not np.allclose(got[i], c.ravel())}
        assert changed == gates[name], name
        if name in ("flip", "rotate"):
            assert all(np.allclose(np.sort(got[i]), np.sort(c.ravel())) for i, c in enumerate(cubes))
        if name in ("brightness", "intensity"):
            i = min(gates[name])
            assert np.ptp(got[i] - cubes[i].ravel() if name == "brightness" else got[i] / cubes[i].ravel()) < 1e-9
        if name == "blur":
            sigma = df.where(F.col("sample_id") == min(gates[name])).select(augment.rng.uniform("chain-blur-by", "sample_id")).first()[0] + 0.5
            w = augment.blur_weights(4, sigma)
            assert np.allclose(got[min(gates[name])].reshape(4, 4, 4), np.einsum("az,by,cx,zyx->abc", w, w, w, cubes[min(gates[name])]))
    full = [sorted((r.sample_id, r.v) for r in augment.pipeline(x, 4, fourier).collect()) for x in (df, df.repartition(5))]
    assert full[0] == full[1]
    with pytest.raises(ValueError):
        augment.pipeline(df, 4, fourier, {"sharpen": 1.0})


@pytest.mark.parametrize("alpha", [0.2, 0.5, 1.3, 2.75])
def test_beta_draws_of_fractional_shapes(spark, alpha):
    """Against the distribution itself, by its moments and by numpy's draws."""
    x = np.sort([r.x for r in spark.range(20000).select(augment.beta("b", alpha, "id").alias("x")).collect()])
    y = np.sort(np.random.default_rng(3).beta(alpha, alpha, 200000))
    at = np.linspace(0.001, 0.999, 400)
    assert ((x >= 0) & (x <= 1)).all() and abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 1 / (4 * (2 * alpha + 1))) < 0.005
    assert np.abs(np.searchsorted(x, at) / len(x) - np.searchsorted(y, at) / len(y)).max() < 0.015


def test_beta_draws(spark):
    draws = np.array([r.x for r in spark.range(4000).select(augment.beta("b", 3, "id").alias("x")).collect()])
    assert abs(draws.mean() - 0.5) < 0.02 and abs(draws.var() - 1 / 28) < 0.005  # of Beta(3, 3)
    with pytest.raises(ValueError):
        augment.beta("b", 0)


def layers(spark, n=120, noise=0.0):
    r = np.random.default_rng(0)
    p = r.uniform(0, 800, (n, 2))
    z = lambda base: base + 0.1 * p[:, 0] - 0.05 * p[:, 1] + r.normal(0, noise, n)
    rows = [(0, name, float(x), float(y), float(v)) for name, base in (("top", 300), ("bottom", 200)) for (x, y), v in zip(p, z(base), strict=True)]
    return spark.createDataFrame([*rows, (1, "top", 1.0, 1.0, 1.0)], "run long, layer string, x double, y double, z double")


@pytest.mark.parametrize("method", kernels.METHODS)
def test_every_slab_method_follows_two_tilted_layers(spark, method):
    got = kernels.slab(layers(spark, noise=2.0), method, 800.0, 800.0, 5, 5).collect()
    assert len(got) == 50 and {r.run for r in got} == {0}
    errors = [r.z - ((300 if r.layer == "top" else 200) + 0.1 * r.col * 200 - 0.05 * r.row * 200) for r in got]
    assert np.sqrt(np.mean(np.square(errors))) < 10
    with pytest.raises(ValueError):
        kernels.slab(layers(spark), "circle", 1.0, 1.0, 2, 2)


def test_planes_by_overlap_find_a_slab(spark):
    a = np.zeros((32, 32, 32))
    a[9:24] = 1
    first = kernels.planes_by_overlap(cut_up(spark, a, 8), 8, iterations=1).first()
    got = kernels.planes_by_overlap(cut_up(spark, a, 8), 8, iterations=25, rate=0.02).first()
    assert got.iou > first.iou and got.iou > 0.8 and abs(got.ny) < 0.2 and abs(got.nx) < 0.2


def test_lookups_and_stores(spark, tmp_path):
    found = spark.createDataFrame([(1, [1.0], [2.0]), (2, None, [3.0])], "run long, data array<double>, `0` array<double>")
    assert {r.run: r.v for r in storage.volume_arrays(found, ["data", "0"]).collect()} == {1: [1.0], 2: [3.0]}
    with pytest.raises(Exception, match="none of"):
        storage.volume_arrays(found, ["data"]).collect()
    with pytest.raises(LookupError):
        storage.the_only(found.where("run = 9"), "run 9")
    assert storage.the_only(found, "run").count() == 2
    assert dict(catalog.label_map(spark.createDataFrame([({"a": 3},)], "labels map<string,int>")).collect()) == {"background": 0, "a": 3}
    sizes = spark.createDataFrame([(1, 8, 8, 8), (2, 9, 9, 9), (5, 8, 8, 8)], "run long, d int, h int, w int")
    samples = spark.createDataFrame([(0, 5), (1, 2), (2, 7)], "sample_id long, run long")
    storage.save_dataset(samples, sizes.where("run IN (2, 5)"), {"boxsize": [4, 4, 4]}, f"file://{tmp_path}/d")
    loaded, metadata = storage.load_dataset(spark, f"file://{tmp_path}/d", sizes.where("run <> 2"))
    assert metadata == {"boxsize": [4, 4, 4]} and [(r.sample_id, r.run) for r in loaded.collect()] == [(0, 1)]


def test_a_failing_run_stays_alone(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "run long, x double")

    def change(pdf):
        if pdf["run"].iloc[0] == 4:
            raise ValueError("four")
        return pdf[["run"]].assign(y=pdf["x"] * 2)

    got = {r.run: r for r in jobs.each_run(rows, "run", change, "run long, y double").collect()}
    assert got[4].error == "ValueError: four" and got[4].y is None and got[5].y == 4.0 and got[5].error is None
    tasks = jobs.run_tasks(spark.range(20).select(F.col("id").alias("task_id")), lambda: 1, lambda s, rows: [s] * len(rows), 3).collect()
    assert [r.task_id for r in tasks] == list(range(20))


def dense_planes(vol, iterations, rate, steep=1000.0):
    """The same steps on the whole volume at once."""
    zz, yy, xx = (np.arange(n).reshape([-1 if k == i else 1 for i in range(3)]) / n for k, n in enumerate(vol.shape))
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -500, 500)))
    p, m, u = np.array([1.0, 0.0, 0.0, -0.8, -0.2]), np.zeros(5), np.zeros(5)

    def overlap(p):
        length = np.linalg.norm(p[:3])
        n = p[:3] / length
        flat = n[2] * yy + n[1] * xx
        top, bottom = -(flat + p[3]) / n[0], -(flat + p[4]) / n[0]
        a, b = sigmoid(steep * (top - zz)), sigmoid(steep * (zz - bottom))
        valid = a * b
        both, total = (valid * vol).sum(), valid.sum() + vol.sum()
        union = total - both
        slope = (vol * (union + both) - both) / union**2 * valid
        by_top, by_bottom = slope * steep * (1 - a), -slope * steep * (1 - b)
        by_n = sum(np.array([(by * -z / n[0]).sum(), (by * -xx / n[0]).sum(), (by * -yy / n[0]).sum()]) for by, z in ((by_top, top), (by_bottom, bottom)))
        return both / union, np.concatenate([(by_n - n * (by_n @ n)) / length, [-by_top.sum() / n[0], -by_bottom.sum() / n[0]]])

    for t in range(1, iterations + 1):
        g = -overlap(p)[1]
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
    return [*p, overlap(p)[0]]


def test_planes_by_overlap_are_those_of_the_whole_volume(spark):
    r = np.random.default_rng(5)
    a = (r.random((16, 24, 8)) < 0.2).astype(float)
    a[5:11] = 1
    got = kernels.planes_by_overlap(cut_up(spark, a, 8), 8, iterations=6).first()
    assert np.allclose(got[1:], dense_planes(a, 6, 0.1), atol=1e-6)


def test_links_of_one_run_are_contracted(spark):
    """Long chains, stars and noise, dealt over many tasks; two runs with the same labels."""
    r = np.random.default_rng(6)
    n = 4000
    pairs = [(int(i), int(i) + 1) for i in r.permutation(1500)] + [(2000, int(j)) for j in range(2001, 2400)] + [tuple(map(int, r.integers(2500, n, 2))) for _ in range(700)]
    links = spark.createDataFrame([(1, b, a) for a, b in pairs] + [(2, 5, 9), (2, 9, 9)], "run long, a long, b long").repartition(23)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {(1, i, find(i)) for i in range(n) if find(i) != i} | {(2, 9, 5)}
    assert {tuple(x) for x in chunks.contracted(links, "run").collect()} == want
    assert chunks.contracted(links.limit(0), "run").count() == 0
    steps = spark.createDataFrame([(1, i, i + 1) for i in range(300)] + [(1, 300, 300), (1, 900, 901), (2, 3, 3)], "run long, a long, b long")
    assert {tuple(x) for x in chunks.followed(steps, "run").collect()} == {(1, i, 300) for i in range(301)} | {(1, 900, 901), (2, 3, 3)}
