"""Fixtures with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import rng, text
from voxloom.operators import classes, geometry, spatial, volume


def samples(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "sample_id long, molecule_id int")


def test_distribution_counts_background(spark):
    got = dict(classes.distribution(samples(spark, [0, 0, 0, 1, 1, 2, -1, -1])).collect())
    assert got == {"class_0": 3, "class_1": 2, "class_2": 1, "background": 2}
    assert classes.distribution(samples(spark, [])).count() == 0


def test_weights_are_total_by_count(spark):
    got = [w for _, w in sorted(classes.weights(samples(spark, [0, 0, 0, 1, 1, 2])).collect())]
    assert got == [2, 2, 2, 3, 3, 6]


def test_sampler_prefers_rare_classes(spark):
    ids = [0, 0, 0, 0, 1, 1, 2]
    drawn = [ids[r.sample_id] for r in classes.draw(samples(spark, ids), 300).collect()]
    assert len(drawn) == 300 and drawn.count(2) > 300 / 7 and drawn.count(0) < 300 * 4 / 7


def test_split_sizes(spark):
    got = classes.split(samples(spark, [0] * 10 + [1] * 10 + [2] * 10)).groupBy("part").count()
    assert dict(got.collect()) == {"train": 18, "val": 6, "test": 6}
    with pytest.raises(ValueError):
        classes.split(samples(spark, [0]), 0.5, 0.2, 0.2)


def test_balancing_targets(spark):
    s = samples(spark, [0] * 10 + [1] * 4)
    assert dict(classes.undersample(s, 0.5).groupBy("molecule_id").count().collect()) == {0: 7, 1: 4}
    assert dict(classes.oversample(s, 0.5).groupBy("molecule_id").count().collect()) == {0: 10, 1: 7}


def cube(spark, *arrays):
    return spark.createDataFrame([(i, [float(x) for x in a.ravel()]) for i, a in enumerate(arrays)], "sample_id long, v array<double>")


def test_dense_operators_against_numpy(spark):
    a = np.random.default_rng(1).normal(size=(4, 4, 4))
    df = cube(spark, a)
    value = lambda d: np.array(d.first()["v"]).reshape(4, 4, 4)
    for axis, k in (("z", 0), ("y", 1), ("x", 2)):
        assert np.array_equal(value(volume.flip(df, axis, 4)), np.flip(a, k))
    for k in (1, 2, 3):
        assert np.array_equal(value(volume.rot90(df, k, ("y", "x"), 4)), np.rot90(a, k, (1, 2)))
        assert np.array_equal(value(volume.rot90(df, k, ("z", "x"), 4)), np.rot90(a, k, (0, 2)))
    assert np.allclose(value(volume.zscore(df)), (a - a.mean()) / (a.std() + 1e-6))
    assert np.array_equal(value(volume.zscore(cube(spark, np.ones((4, 4, 4))), guarded=True)), np.ones((4, 4, 4)))


def test_blur_keeps_constants(spark):
    assert {to: round(sum(w for t, _, w in volume.kernel(4, 1.0) if t == to), 12) for to in range(4)} == dict.fromkeys(range(4), 1.0)


def test_mixup_never_pairs_a_sample_with_itself(spark):
    s = samples(spark, [0] * 50)
    pairs = volume.mixup_partners(s).collect()
    assert len(pairs) == 50 and all(p.sample_id != p.partner_id for p in pairs)
    assert volume.mixup_partners(samples(spark, [0])).count() == 0


def gradient(spark, side=32, edge=4):
    a = np.add.outer(np.add.outer(np.arange(side), np.arange(side)), np.arange(side)).astype(float)
    rows = [(0, z, y, x, a[z * edge : z * edge + edge, y * edge : y * edge + edge, x * edge : x * edge + edge].ravel().tolist()) for z in range(side // edge) for y in range(side // edge) for x in range(side // edge)]
    return a, spark.createDataFrame(rows, "run long, cz int, cy int, cx int, v array<double>")


@pytest.mark.parametrize(("at", "status"), [((16, 16, 16), "valid"), ((3, 16, 16), "padded"), ((2, 2, 2), "padded"), ((-20, 5, 5), "invalid")])
def test_extraction(spark, at, status):
    a, chunks = gradient(spark)
    points = spark.createDataFrame([(7, 0, *map(float, at))], "point_id long, run long, x double, y double, z double")
    placed = spatial.boxes(points, 16, 32)
    assert placed.first()["status"] == status
    got = np.zeros((16, 16, 16))
    for r in spatial.cut(placed, chunks, 4).collect():
        got[r.z, r.y, r.x] = r.v
    want = np.zeros((16, 16, 16))
    if status != "invalid":
        x, y, z = at
        part = a[max(0, z - 8) : z + 8, max(0, y - 8) : y + 8, max(0, x - 8) : x + 8]
        p = [max(0, 8 - c) for c in (z, y, x)]
        want[p[0] : p[0] + part.shape[0], p[1] : p[1] + part.shape[1], p[2] : p[2] + part.shape[2]] = part
    assert np.array_equal(got, want)


def test_background_keeps_its_distance(spark):
    picks = spark.createDataFrame([(0, 16.0, 16.0, 16.0), (0, 40.0, 40.0, 40.0), (0, 16.0, 40.0, 40.0)], "run long, x double, y double, z double")
    points = spatial.background(picks, 64, 16, 20.0, 1.0).collect()
    assert 1 <= len(points) <= 3
    for p in points:
        assert all((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 >= 400 for q in picks.collect())
    assert spatial.background(picks, 64, 16, 100.0, 1.0).count() == 0
    assert spatial.background(picks.limit(0), 64, 16, 20.0).count() == 0


def test_plane_fits(spark):
    r = np.random.default_rng(0).uniform(0, 800, (120, 2))
    points = spark.createDataFrame([(0, "top", float(x), float(y), float(200 + 0.5 * x - 0.3 * y)) for x, y in r] + [(0, "bottom", float(x), float(y), float(100 + 0.5 * x - 0.3 * y)) for x, y in r], "run long, layer string, x double, y double, z double")
    f = geometry.parallel_planes(points).first()
    assert abs(f.top - f.bottom - 100) < 1e-6 and abs(f.a - 0.5) < 1e-9 and abs(f.b + 0.3) < 1e-9
    assert geometry.plane_fit(points.limit(2)).count() == 0


def test_bending_energy_of_an_affine_grid(spark):
    grid = spark.createDataFrame([(0, i, j, 0.3 * i - 0.2 * j + 1) for i in range(6) for j in range(5)], "id int, row int, col int, v double")
    assert geometry.bending_energy(grid, "id").first()["energy"] == 0


def test_slab_surface(spark):
    mask = spark.createDataFrame([(0, z, y, x) for z in range(4, 10) for y in range(5, 25) for x in range(5, 25)], "run long, z int, y int, x int")
    got = geometry.surface_points(mask, 10.0)
    assert got.count() == 400 and got.select("bottom", "top").distinct().collect() == [(40.0, 90.0)]


def test_mesh_is_closed(spark):
    runs = spark.createDataFrame([(0,)], "run long")
    faces = geometry.mesh(runs, 4, 3).collect()
    edges = {}
    for f in faces:
        for e in ((f.a, f.b), (f.b, f.c), (f.c, f.a)):
            edges[e] = edges.get(e, 0) + 1
    assert all(n == 1 and edges.get((b, a)) == 1 for (a, b), n in edges.items())
    assert len(faces) == 4 * 3 * 2 + 4 * 3 + 4 * 2


def test_strings(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(text.output_name(F.lit("v"), F.lit(2.5), F.lit(0.0), F.lit(None).cast("string"))) == "v-lp2A"
    assert one(text.list_items(F.lit("[a, b ,c]"))) == ["a", "b", "c"]
    assert one(text.cache_key(F.lit("c.json"), [F.lit(16)] * 3, F.lit(10.0), F.lit(True), F.lit("parquet"))) == "c.json_16x16x16_10.0_with_bg.parquet"
    with pytest.raises(Exception, match="malformed"):
        one(text.tomogram_uri(F.lit("no spacing")))
    assert 0 <= one(rng.uniform("s", F.lit(1))) < 1


def test_numbers_follow_the_order_within_large_groups(spark):
    from voxloom.functions import number

    rows = spark.createDataFrame([(i * 3001 % 50_000, "a" if i % 3 else "b") for i in range(2000)], "id long, g string").distinct()
    got = number.numbered(rows, ["g"], number.of_ids("id"), ["id"], "n").collect()
    for g in "ab":
        ids = sorted(r.id for r in got if r.g == g)
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.id)] == list(range(1, len(ids) + 1))
    keyed = number.numbered(rows.withColumn("k", rng.shuffle_key("s", "id")), [], number.of_text(F.col("k")), ["k", "id"], "n").collect()
    assert [r.n for r in sorted(keyed, key=lambda r: r.k)] == list(range(1, len(keyed) + 1))


def test_erosion_is_the_opposite_of_dilation(spark):
    from voxloom.operators import dataset

    r = np.random.default_rng(5)
    a = r.normal(size=(5, 5, 5)).round(6)
    vox = spark.createDataFrame([(0, z, y, x, float(a[z, y, x])) for z in range(5) for y in range(5) for x in range(5)], "run long, z int, y int, x int, v double")
    low = {(p.z, p.y, p.x): p.v for p in dataset.morphology(vox, "run", 5, 1, "erode").collect()}
    high = {(p.z, p.y, p.x): p.v for p in dataset.morphology(vox.withColumn("v", -F.col("v")), "run", 5, 1, "dilate").collect()}
    assert len(low) == 125 and all(low[k] == -high[k] for k in low)


def test_parameters_that_are_refused(spark):
    s = samples(spark, [0, 0, 1])
    for f in (classes.oversample, classes.undersample):
        for ratio in (0.0, -0.5, 1.5):
            with pytest.raises(ValueError):
                f(s, ratio)
    for ratios in ((0.5, 0.2, 0.2), (0.6, 0.6, 0.1)):
        with pytest.raises(ValueError):
            classes.split(s, *ratios)
    for overlap in (1.0, -0.1):
        with pytest.raises(ValueError):
            spatial.grid_patches(s.withColumnRenamed("sample_id", "run"), 32, 8, overlap)
    with pytest.raises(ValueError):
        spatial.strategy_shift("spiral", 8)
    with pytest.raises(ValueError):
        spatial.region(s, 8, z=(9, 12))
    assert volume.without_idle_decay(0, 2.0) == 0 and volume.without_idle_decay(5.0, 2.0) == 2.0
    n = spark.createDataFrame([(7,), (8,)], "n int").select(volume.positive_frequencies(F.col("n"), 2.0).alias("f")).collect()
    for r, k in zip(n, (7, 8)):
        want = np.fft.fftfreq(k, 2.0)
        assert np.allclose(r.f, want[want >= 0])
