"""Dense kernels, fits, jobs and storage against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import chunks, geometry, jobs, kernels
from voxloom.sources import storage
from voxloom.streaming.classes import running_distribution


def cube(spark, *arrays):
    return spark.createDataFrame([(i, [float(x) for x in a.ravel()]) for i, a in enumerate(arrays)], "sample_id long, v array<double>")


def values(df, side):
    return [np.array(r.v).reshape((side,) * 3) for r in df.orderBy("sample_id").collect()]


def test_filters_that_change_nothing(spark):
    a = np.random.default_rng(0).normal(size=(8, 8, 8))
    for df in (kernels.bandpass(cube(spark, a), 8), kernels.fourier_augment(cube(spark, a), 8, 0.0, 0.0, (1.0, 1.0)), kernels.fourier_augment(cube(spark, a), 8, prob=0.0), kernels.rotate(cube(spark, a), 8, 0.0)):
        assert np.allclose(values(df, 8)[0], a)


def test_augmentation_depends_on_seed_and_sample_only(spark):
    a = np.random.default_rng(0).normal(size=(4, 4, 4))
    one = values(kernels.fourier_augment(cube(spark, a, a), 4), 4)
    two = values(kernels.fourier_augment(cube(spark, a, a).repartition(3), 4), 4)
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]) and not np.allclose(one[0], one[1])


def test_fourier_augmentation_by_its_definition(spark):
    """Dropped shares, phase noise and scale, one at a time, on the spectrum of what comes out."""
    a = np.random.default_rng(0).normal(size=(8, 8, 8))
    assert np.allclose(values(kernels.fourier_augment(cube(spark, a), 8, 1.0, 0.0, (1.0, 1.0)), 8)[0], 0)
    assert np.allclose(values(kernels.fourier_augment(cube(spark, a), 8, 0.0, 0.0, (2.0, 2.0)), 8)[0], 2 * a)
    cubes = values(kernels.fourier_augment(cube(spark, *[a] * 40), 8, 0.3, 0.0, (1.0, 1.0)), 8)
    kept = np.mean([np.abs(np.fft.fftn(c)) / np.abs(np.fft.fftn(a)) for c in cubes])
    assert abs(kept - 0.7) < 0.02  # a frequency and its mirror image are dropped each by itself, the real part halves them
    noisy = values(kernels.fourier_augment(cube(spark, a), 8, 0.0, 0.1, (1.0, 1.0)), 8)[0]
    turned = np.angle(np.fft.fftn(noisy) / np.fft.fftn(a))
    assert 0.03 < turned.std() < 0.12 and abs(np.linalg.norm(noisy) / np.linalg.norm(a) - 1) < 0.02
    r = np.random.default_rng([5, 1])
    r.random()
    spectrum = np.fft.fftshift(np.fft.fftn(a))
    spectrum = np.abs(spectrum) * (r.random(a.shape) >= 0.2) * np.exp(1j * (np.angle(spectrum) + r.normal(0, 0.1, a.shape)))
    want = np.fft.ifftn(np.fft.ifftshift(spectrum)).real * r.uniform(0.8, 1.2)
    assert np.allclose(values(kernels.fourier_augment(cube(spark, a, a), 8, 0.2, 0.1, (0.8, 1.2), seed=5), 8)[1], want)


def test_quarter_turn(spark):
    a = np.random.default_rng(0).normal(size=(5, 5, 5))
    assert np.allclose(values(kernels.rotate(cube(spark, a), 5, 90.0), 5)[0], np.rot90(a, -1, (1, 2))) or np.allclose(values(kernels.rotate(cube(spark, a), 5, 90.0), 5)[0], np.rot90(a, 1, (1, 2)))


def test_low_pass_keeps_the_mean(spark):
    a = np.random.default_rng(0).normal(size=(8, 8, 8))
    assert np.allclose(values(kernels.bandpass(cube(spark, a), 8, low_pass=0.5), 8)[0], a.mean())


def test_rescaling_a_constant_volume(spark):
    whole = spark.createDataFrame([(0, z, y, x, [2.0] * 64) for z in range(2) for y in range(2) for x in range(2)], "run long, cz int, cy int, cx int, v array<double>")
    got = chunks.rescaled(whole, "run", 4, 10.0, 20.0).collect()
    assert len(got) == 64 and {(r.d, r.h, r.w) for r in got} == {(4, 4, 4)} and np.allclose([r.v for r in got], 2.0 * np.sqrt(512 / 64))
    with pytest.raises(ValueError):
        chunks.rescaled(whole, "run", 4, 10.0, 5.0)


def test_components_against_a_flood_fill(spark):
    set_ = np.random.default_rng(3).random((6, 6, 6)) < 0.12
    places = [tuple(map(int, p)) for p in np.argwhere(set_)]
    group = {}
    for p in places:
        if p in group:
            continue
        group[p], todo = p, [p]
        while todo:
            q = todo.pop()
            for n in places:
                if n not in group and max(abs(a - b) for a, b in zip(q, n)) <= 1:
                    group[n] = p
                    todo.append(n)
    got = {(r.z, r.y, r.x): r.component for r in kernels.components(spark.createDataFrame([(0, *p) for p in places], "run long, z int, y int, x int")).collect()}
    assert {(got[a] == got[b], group[a] == group[b]) for a in places for b in places} <= {(True, True), (False, False)}


def test_spline_follows_a_tilted_plane_and_two_layers(spark):
    r = np.random.default_rng(1).uniform(0, 800, (200, 2))
    rows = [(0, layer, float(x), float(y), float(base + 0.05 * x - 0.03 * y)) for layer, base in (("top", 300), ("bottom", 200)) for x, y in r]
    fits = kernels.spline_fit(spark.createDataFrame([*rows, (1, "top", 1.0, 1.0, 1.0)], "run long, layer string, x double, y double, z double"), 800.0, 800.0)
    by_run = {f.run: f for f in fits.collect()}
    assert by_run[1].error and by_run[0].error is None and abs(by_run[0].top - by_run[0].bottom - 100) < 0.01
    for z in kernels.spline_lattice(fits, 5, 5).collect():
        x, y = z.col * 200, z.row * 200
        assert abs(z.z - ((300 if z.layer == "top" else 200) + 0.05 * x - 0.03 * y)) < 10


def test_stiff_surfaces_are_flatter(spark):
    r = np.random.default_rng(2).uniform(0, 1000, (300, 2))
    points = spark.createDataFrame([(0, "top", float(x), float(y), float(120 * np.sin(x / 150))) for x, y in r], "run long, layer string, x double, y double, z double")
    def energy(stiffness):
        f = kernels.spline_fit(points, 1000.0, 1000.0, 7, stiffness).first()
        grid = spark.createDataFrame([(0, i, j, float(np.reshape(f.control, (7, 7))[i, j])) for i in range(7) for j in range(7)], "id int, row int, col int, v double")
        return geometry.bending_energy(grid, "id").first()["energy"]
    assert energy(200.0) < energy(0.0)


def test_failing_tasks_stay_alone(spark):
    tasks = spark.range(40).select(F.col("id").alias("task_id"))

    def work(state, rows):
        if (rows["task_id"] == 7).any():
            raise ZeroDivisionError("seven")
        return state // (rows["task_id"] - 7)

    got = {r.task_id: r for r in jobs.run_tasks(tasks, lambda: 10, work, 3).collect()}
    assert len(got) == 40 and [i for i, r in got.items() if not r.success] == [7] and got[7].error == "ZeroDivisionError: seven" and got[7].result is None
    assert all(got[i].result == 10 // (i - 7) and got[i].error is None for i in got if i != 7)
    broken = jobs.run_tasks(tasks, lambda: 1 / 0, lambda s, r: 1, 2)
    assert broken.where("success").count() == 0 and broken.count() == 40
    assert jobs.run_tasks(tasks.where("task_id < 0"), lambda: 1 / 0, work, 2).count() == 0


@pytest.mark.parametrize("bad", [[], [0], [999], [3, 4, 500], list(range(0, 1000, 2)), list(range(1000))])
def test_bad_rows_are_found_by_halves(bad):
    calls = []

    def work(rows):
        calls.append(len(rows))
        if rows["x"].isin(bad).any():
            raise KeyError(int(rows["x"].iloc[0]))
        return rows["x"] * 2.0

    done = jobs.alone(work, pd.DataFrame({"x": range(1000)}))
    assert list(np.flatnonzero(done["error"].notna())) == bad
    assert all(done["error"][i] == f"KeyError: {i}" and np.isnan(done["result"][i]) for i in bad)
    assert all(done["result"][i] == 2 * i for i in set(range(1000)) - set(bad))
    assert len(calls) <= 1 + 2 * len(bad) * 10


def test_versions_are_seen_as_a_whole_or_not_at_all(spark, tmp_path):
    """A second table that fails leaves the version before in force, for every reader."""
    path, place = f"file://{tmp_path}/mesh", tmp_path / "mesh"
    rows = lambda n: spark.range(n).select(F.lit(1).alias("run"), "id")
    assert storage.latest(spark, path) is None
    assert storage.write_mesh(rows(4), rows(2), path).first()[:] == (1, 4, 2)
    first = storage.latest(spark, path)
    broken = rows(3).withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        storage.write_mesh(rows(9), broken, path)
    assert storage.latest(spark, path) == first and spark.read.parquet(f"{first}/vertices").count() == 4
    before = spark.read.parquet(f"{first}/faces")
    assert storage.write_mesh(rows(5), rows(3), path).first()[:] == (1, 5, 3)
    assert storage.latest(spark, path) != first and before.count() == 2  # a reader of the one before goes on
    storage.write_mesh(rows(6), rows(1), path)
    assert len(storage.versions(spark, path)) == 2 and not (place / first.rsplit("/", 1)[1]).exists()


def test_an_unfinished_cache_is_built_again(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    samples = spark.createDataFrame([(0, 1), (1, 2)], "sample_id long, molecule_id int")
    with pytest.raises(Exception, match="lost"):
        storage.write_cache(samples.withColumn("v", F.when(F.col("sample_id") == 1, F.raise_error(F.lit("lost")).cast("double"))), path)
    (tmp_path / "cache").mkdir(exist_ok=True)
    assert storage.cache_folder(spark, path) is None
    assert storage.cached(spark, path, lambda: samples).count() == 2
    assert storage.cached(spark, path, lambda: 1 / 0).count() == 2
    samples.write.parquet(f"{path}-old")  # as caches were before they had versions
    assert storage.cached(spark, f"{path}-old", lambda: 1 / 0).count() == 2
    with pytest.raises(LookupError):
        storage.load_dataset(spark, f"{path}-none", samples)


def test_storage(spark, tmp_path):
    (tmp_path / "project.json").write_text('{"name": "p", "pickable_objects": [{"name": "a", "label": 1, "is_particle": true, "radius": 60}]}')
    assert [(o.name, o.label) for o in storage.project(spark, f"file://{tmp_path}/project.json").collect()] == [("a", 1)]
    np.save(tmp_path / "run1.npy", np.arange(24.0).reshape(2, 3, 4))
    v = storage.read_volumes(spark, f"file://{tmp_path}").first()
    assert v.run == "run1" and v.shape == [2, 3, 4] and v.v == list(range(24))
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, 1, [1.0]), (1, 2, [0.0])], "sample_id long, molecule_id int, v array<double>")

    path = f"file://{tmp_path}/cache"
    for most, n in ((None, 2), (1, 1)):
        df = storage.cached(spark, path, build, most)
        assert df.count() == n and {"is_background", "key"} <= set(df.columns)
    assert len(calls) == 1
    assert storage.cached(spark, None, build).count() == 2
    storage.write_volumes(spark.createDataFrame([("r", "wbp", 10.0, [1.0])], "run string, tomo_type string, voxel_spacing double, v array<double>"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").where("tomo_type = 'wbp'").count() == 1
    storage.log_job(spark, f"file://{tmp_path}/log", "filter", {"a": 1}, {"lp": 2.5}, {"n": 3})
    assert spark.read.json(f"file://{tmp_path}/log").count() == 1


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = running_distribution(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("running").collect()) == sorted(running_distribution(events).collect())
