"""What must not grow with the tables: rows that are broadcast, shuffled or computed twice, and what a task holds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxloom.operators import chunks, dataset, jobs, kernels, spatial


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_weights_of_a_kernel_are_computed_before_its_voxels(spark):
    df = dataset.gaussian_kernels(spark.range(3).select(F.col("id").alias("ord"), (F.col("id") + 1.0).alias("sigma")), 5)
    text = plan(df, "optimizedPlan")
    assert text.index("Generate explode") < text.index("EXP(")  # printed from the top
    assert df.count() == 3 * 125


def test_spheres_are_painted_without_a_shuffle_or_broadcast(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("run")).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert "Exchange" not in plan(dataset.spheres(runs, 16, 12))
    assert "Broadcast" not in plan(dataset.sphere_volumes(runs, 16, 12))  # few bytes, of which many rows are made


def test_spheres_of_volumes_that_are_no_whole_chunks(spark):
    runs = spark.range(2).select(F.col("id").alias("run"))
    found = {(r.run, r.z, r.y, r.x): r.v for r in dataset.sphere_volumes(runs, 20, 3).collect()}
    assert len(found) == 2 * 20**3
    some = {(r.run, r.z, r.y, r.x): r.v for r in dataset.spheres(runs, 20, 3).collect()}
    for run in range(2):
        v = [some.get((run, z, y, x), 0.0) for z in range(20) for y in range(20) for x in range(20)]
        mean = sum(v) / len(v)
        sd = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5
        got = [found[run, z, y, x] for z in range(20) for y in range(20) for x in range(20)]
        assert max(abs(g - (x - mean) / sd) for g, x in zip(got, v, strict=True)) < 2e-6


def test_sums_of_a_fit_travel_as_arrays(spark):
    rows = [(r, "top" if i % 2 else "bottom", float(i % 7), float(i * 3 % 11), float(i)) for r in (1, 2) for i in range(40)] + [(3, "top", 1.0, 1.0, 1.0)]
    fits = kernels.spline_fit(spark.createDataFrame(rows, "run long, layer string, x double, y double, z double"), 10.0, 11.0)
    assert "Generate" not in plan(fits, "optimizedPlan")  # no row for each product
    assert {r.run: (r.n, r.error) for r in fits.collect()} == {1: (40, None), 2: (40, None), 3: (1, "fewer than three points")}
    assert kernels.spline_lattice(fits, 2, 3).count() == 2 * 2 * 2 * 3


def test_boxes_are_cut_out_of_a_bounded_number_of_lists_at_once(spark, monkeypatch):
    cubes = [(r, 0, 0, x, [float(r + x * 10 + i) for i in range(8)]) for r in range(3) for x in range(2)]
    volumes = spark.createDataFrame(cubes, "run int, cz int, cy int, cx int, v array<double>")
    points = spark.createDataFrame([(r * 10 + i, r, 0.5 + i * 0.3, 1.0, 1.0) for r in range(3) for i in range(9)], "point_id int, run int, x double, y double, z double")
    cut = lambda: sorted(map(tuple, spatial.digest(spatial.pieces(spatial.boxes(points, 2, 4), volumes, 2), 2).collect()))
    want = cut()
    for name, most in (("AT_ONCE", 2), ("LISTS", 1), ("HELD", 5)):
        monkeypatch.setattr(spatial, name, most)
    assert cut() == want and len(want) == 27


def test_tasks_are_shuffled_and_done_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def work(state, rows):
        counted.add(len(rows))
        return rows["task_id"] * state

    tasks = spark.range(300, 0, -1).select(F.col("id").alias("task_id"))
    done = jobs.run_tasks(tasks, lambda: 2, work, 3)
    assert plan(done).count("Exchange") == 1
    assert [(r.task_id, r.result) for r in done.collect()] == [(i, 2.0 * i) for i in range(1, 301)]
    assert counted.value == 300


def test_a_task_contracts_a_bounded_number_of_links_at_once(spark, monkeypatch):
    monkeypatch.setattr(chunks, "LINKS", 5)
    monkeypatch.setattr(np, "unique", seen := Seen(np.unique))
    links = spark.createDataFrame([(1, i, i + 1) for i in range(40)], "run long, a long, b long").coalesce(1)
    batches = [b for b in pa.Table.from_pandas(links.toPandas()).to_batches()]
    list(chunks.forested(iter(batches), "run"))
    assert max(seen.sizes) <= 10
    assert {(r.label, r.root) for r in chunks.contracted(links, "run").collect()} == {(i, 0) for i in range(1, 41)}


class Seen:
    def __init__(self, of):
        self.of, self.sizes = of, []

    def __call__(self, x, *a, **k):
        self.sizes.append(len(x))
        return self.of(x, *a, **k)
