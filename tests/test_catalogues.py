"""Catalogues with several entries of a label, pyramid levels, masks by name, stored targets, filters of many jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import catalog, dataset, kernels, volume


def test_the_first_name_of_a_label_is_the_first_in_the_catalogue(spark):
    objects = spark.createDataFrame([(3, "a", 1), (1, "z", 1), (2, "m", 2), (9, None, 3)], "ord long, object_name string, label int")
    assert {r.label: r.object_name for r in dataset.first_names(objects).collect()} == {1: "z", 2: "m", 3: None}
    assert dataset.first_names(objects.limit(0)).count() == 0


def test_levels_follow_from_radius_and_sizes_from_levels(spark):
    wanted = spark.createDataFrame([(1, 0, "a", 16.0), (1, 1, "b", 16.5), (2, 0, "a", 16.0)], "run long, ord long, object_name string, radius double")
    volumes = spark.createDataFrame([(1, 9, 8, 7)], "run long, d int, h int, w int")
    got = {(r.run, r.ord): (r.level, r.scale, r.d, r.h, r.w) for r in catalog.arrays_at_level(wanted, volumes).collect()}
    assert got == {(1, 0): (0, 1, 9, 8, 7), (1, 1): (1, 2, 4, 4, 3), (2, 0): (0, 1, None, None, None)}


def test_masks_are_skipped_in_any_case(spark):
    masks = spark.createDataFrame([("Membrane",), ("MEMBRANE",), ("membranes",), (None,)], "name string")
    assert [r.name for r in catalog.without_named(masks, "membrane").collect()] == ["membranes"]


def test_every_stored_target_table_has_background(spark):
    stored = spark.createDataFrame([("x", {"a": 3, "background": 7}), ("y", {})], "config string, labels map<string,int>")
    assert {tuple(r) for r in catalog.label_map(stored, "config").collect()} == {("x", "background", 0), ("x", "a", 3), ("y", "background", 0)}


@pytest.mark.parametrize("cut", [(0, 0, 0, 0), (5, 2, 0, 0), (5, 0, 2, 0), (6, 2, 2, 1), (0, 0, 3, 2)])
def test_profiles_of_jobs_are_lines_of_their_masks(spark, cut):
    jobs = spark.createDataFrame([(1, *map(float, cut))], "ord long, low_pass double, low_decay double, high_pass double, high_decay double")
    got = {r.x: r.w for r in volume.filter_profiles(jobs, "ord", 16).collect()}
    want = kernels.mask((16, 16, 16), *cut)[8, 8]
    assert np.allclose([got[x] for x in range(16)], want, atol=1e-6)


def test_synthetic_volumes_are_normalised_one_by_one(spark):
    rows = dataset.sphere_volumes(spark.range(3).select(F.col("id").alias("run")), 12, 4).groupBy("run").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).collect()
    assert len(rows) == 3 and all(r.n == 12**3 and abs(r.mean) < 1e-5 and abs(r.sd - 1) < 1e-5 for r in rows)
