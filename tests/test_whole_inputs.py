"""Queries over all rows of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from voxloom.operators import spatial
from voxloom.plans import registry
from voxloom.sources import model

SF = "/root/testdata/sf0.001"

@pytest.mark.parametrize("name", ["background_points", "background_points_continuous", "samples_with_background", "background_boxes"])
def test_background_is_sought_around_every_pick(spark, name):
    assert "% 50" not in registry.ORACLE_SQL[name]
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_background_by_brute_force(spark):
    picks = spatial.to_voxels(model.picks(spark, SF), model.SPACING).withColumn("run", F.expr("point_id div 12"))
    by_run, want = {}, {}
    for p in picks.collect():
        by_run.setdefault(p.run, []).append(p)
    assert sum(map(len, by_run.values())) == spark.read.parquet(f"{SF}/events.parquet").count()
    for c in sorted(spatial.candidates(picks.groupBy("run").agg(F.floor(F.count(F.lit(1)) * 1.5).cast("int").alias("want")), model.EXTENT, 4, "background").collect(), key=lambda c: c.attempt):
        free = all((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2 >= 4 for p in by_run[c.run])
        if free and len(want.setdefault(c.run, [])) < c.want:
            want[c.run].append((c.run, c.attempt, c.x, c.y, c.z))
    got = registry.QUERIES["background_points"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(x for xs in want.values() for x in xs)


@pytest.mark.parametrize("name", ["background_points", "background_points_continuous"])
def test_background_shuffles_picks_once_and_no_attempts(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("whole", [True, False])
def test_background_of_small_and_large_runs(spark, monkeypatch, whole):
    """Runs with room, a crowded one, one without points and one without a name, by list, by cell, and by both."""
    r, rows = np.random.default_rng(4), []
    for run, n, side in [(1, 3, 16), (2, 40, 16), (3, 90, 5), (4, 1, 16), (None, 5, 16)]:
        rows += [(run, *map(float, r.uniform(0, side, 3))) for _ in range(n)]
    picks = spark.createDataFrame([*rows, (1, None, 1.0, 1.0)], "run long, x double, y double, z double")
    found = {}
    for few in (0, 50, 1000):
        monkeypatch.setattr(spatial, "FEW", few)
        got = spatial.background(picks, 16, 6, 2.0, 0.9, "s", whole)
        found[few] = sorted(map(tuple, got.collect()))
    assert found[0] == found[50] == found[1000]
    wanted = spark.createDataFrame([(1, 3), (2, 36), (3, 81)], "run long, want int")
    want = {}
    for c in sorted(spatial.candidates(wanted, 16, 6, "s", whole).collect(), key=lambda c: c.attempt):
        free = all(sum((a - b) ** 2 for a, b in zip((c.x, c.y, c.z), at, strict=True)) >= 4 for run, *at in rows if run == c.run)
        if free and len(want.setdefault(c.run, [])) < c.want:
            want[c.run].append((c.run, c.attempt, c.x, c.y, c.z))
    assert found[0] == sorted(x for xs in want.values() for x in xs)


@pytest.mark.parametrize("name", ["connected_components", "largest_component"])
def test_whole_masks_are_labelled(spark, name):
    assert "% 4 <>" not in registry.ORACLE_SQL[name]
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_slab_follows_the_largest_component_of_the_whole_mask(spark, tmp_path):
    """One volume with a block of 4 x 8 x 8 voxels: a flat slab between z = 20 and 50 angstrom."""
    cube = lambda c: [1.0 if 2 <= c // 4 * 4 + i // 16 <= 5 else 0.0 for i in range(64)]
    spark.createDataFrame([(c, 0, cube(c)) for c in range(8)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    folder = f"file://{tmp_path}"
    assert registry.QUERIES["connected_components"](spark, folder).count() == 256
    largest = registry.QUERIES["largest_component"](spark, folder).collect()
    assert [(r.area, r.cz, r.cy, r.cx) for r in largest] == [(256, 3.5, 3.5, 3.5)]
    slab = registry.QUERIES["slab_from_segmentation"](spark, folder).collect()
    assert slab and all(abs(r.z - (50 if r.layer == "top" else 20)) < 0.01 for r in slab)


def test_slabs_from_all_picks_and_from_too_few(spark, tmp_path):
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = registry.QUERIES["slab_from_picks"](spark, SF).collect()
    assert {r.run: r.n for r in got} == dict(line.groupBy("l_suppkey").count().collect())
    assert all(r.error is None and r.thickness is not None for r in got)
    two = line.where("l_suppkey = 3").limit(2)
    line.where("l_suppkey = 1").unionByName(two).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    few = {r.run: r for r in registry.QUERIES["slab_from_picks"](spark, f"file://{tmp_path}").collect()}
    assert set(few) == {1, 3} and few[1].error is None
    assert (few[3].n, few[3].error, few[3].thickness) == (2, "fewer than three points", None)
    two.write.parquet(f"{tmp_path}/alone/lineitem.parquet")
    assert [r.error for r in registry.QUERIES["slab_from_picks"](spark, f"file://{tmp_path}/alone").collect()] == ["fewer than three points"]
