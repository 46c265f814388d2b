"""Slabs of segmentations by every method, crops that are cut, and volumes that are loaded once."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import chunks, slabs, sliding, splicing

EDGE, SPACING = 8, 10.0


def as_chunks(spark, volumes, edge=EDGE):
    rows = []
    for run, v in volumes.items():
        padded = np.full([-(-n // edge) * edge for n in v.shape], np.nan)
        padded[tuple(map(slice, v.shape))] = v
        for at in np.ndindex(*[n // edge for n in padded.shape]):
            cube = padded[tuple(slice(a * edge, (a + 1) * edge) for a in at)]
            rows.append((run, *at, [float(x) for x in cube.ravel()]))
    return spark.createDataFrame(rows, "run long, cz int, cy int, cx int, v array<double>")


def tilted(d=24, h=16, w=20, a=0.25, b=0.0, low=6, thick=8):
    """A tilted slab of label 3, a small body of the same label apart from it, and other labels."""
    z, y, x = np.indices((d, h, w))
    bottom = low + a * x + b * y
    v = np.where((z >= bottom) & (z <= bottom + thick), 3.0, 0.0)
    v[0:2, 0:2, 0:2] = 3
    v[:2, -2:, -2:] = 5
    return v


@pytest.fixture(scope="module")
def volumes(spark):
    empty, few = np.zeros((16, 16, 16)), np.zeros((16, 16, 16))
    few[3:9, 4, 4:6] = 3
    line = np.zeros((16, 16, 16))
    line[5:8, 6, 2:12] = 3
    return as_chunks(spark, {1: tilted(), 2: empty, 3: few, 4: line, 5: tilted(a=0.0, b=0.25)}).cache()


def test_only_the_largest_body_of_the_label_is_kept(spark, volumes):
    got = {}
    for r in chunks.flat(slabs.body(volumes, EDGE, 3), "run", EDGE).where("v > 0").collect():
        got.setdefault(r.run, set()).add((r.z, r.y, r.x))
    want = tilted() == 3
    want[0:2, 0:2, 0:2] = False
    assert got[1] == set(map(tuple, np.argwhere(want).tolist())) and 2 not in got and len(got[3]) == 12


@pytest.mark.parametrize("stride", [1, 3])
def test_ends_of_columns(spark, volumes, stride):
    got = {(r.y, r.x): (r.low, r.high) for r in slabs.surface(volumes.where("run = 1").withColumn("v", F.transform("v", lambda x: (x == 3).cast("double"))), EDGE, stride).collect()}
    mask, want = tilted() == 3, {}
    for y, x in np.ndindex(*mask.shape[1:]):
        z = np.flatnonzero(mask[:, y, x])
        if len(z) and y % stride == 0 and x % stride == 0:
            want[y, x] = (z[0], z[-1])
    assert got == want


@pytest.mark.parametrize("method", [None, "Spline", "parallel"])
def test_surfaces_follow_a_tilted_slab(spark, volumes, method):
    surfaces, report = slabs.slab_of_segmentation(volumes, EDGE, SPACING, 3, method, 5, 6)
    told = {r.run: (r["columns"], r.error) for r in report.collect()}
    assert told == {1: (320, None), 2: (0, "nothing has the label"), 3: (2, "fewer than three columns"), 4: (10, None), 5: (320, None)}
    rows = surfaces.where("run IN (1, 5)").collect()
    assert len(rows) == 2 * 2 * 5 * 6 and {r.run for r in surfaces.collect()} <= {1, 4, 5}
    for r in rows:
        along = {1: r.x, 5: r.y}[r.run] * 0.25
        want = 60 + along + (80 if r.layer == "top" else 0)
        assert (r.x, r.y) == pytest.approx((r["col"] / 5 * 200, r["row"] / 4 * 160))
        assert abs(r.z - want) < 12  # a voxel, and the slope beyond the last column


def test_planes_of_most_overlap_follow_a_flat_slab(spark):
    flat = np.zeros((16, 16, 16))
    flat[4:12] = 3
    surfaces, report = slabs.slab_of_segmentation(as_chunks(spark, {1: flat}), EDGE, SPACING, 3, "overlap", 2, 2, iterations=60, rate=0.02)
    assert report.first().error is None
    z = {(r.layer, r["row"], r["col"]): r.z for r in surfaces.collect()}
    assert len(z) == 8
    for r, k in np.ndindex(2, 2):
        assert abs(z["top", r, k] - 120) < 15 and abs(z["bottom", r, k] - 40) < 15


def test_refused_slabs(spark, volumes):
    for method, sizes in (("plane", {}), ("coupled", {"rows": 1}), ("coupled", {"stride": 0})):
        with pytest.raises(ValueError):
            slabs.slab_of_segmentation(volumes, EDGE, SPACING, 3, method, **sizes)
    surfaces, report = slabs.slab_of_segmentation(volumes.where("run < 0"), EDGE, SPACING, 3)
    assert surfaces.count() == 0 and report.count() == 0


def test_crops_are_cut_or_resized(spark):
    r = np.random.default_rng(0)
    big, thin, exact = r.normal(size=(24, 20, 17)), r.normal(size=(24, 5, 17)), r.normal(size=(6, 6, 6))
    held = as_chunks(spark, {1: big, 2: thin, 3: exact})
    wanted = spark.createDataFrame([(i, 1) for i in range(30)] + [(30, 2), (31, 3), (32, 9)], "id long, run long")
    got = {x.id: np.reshape(x.v, (6, 6, 6)) for x in splicing.cropped(wanted, held, EDGE, 6).collect()}
    assert set(got) == set(range(32))
    corners = set()
    for i in range(30):
        z, y, x = np.argwhere(big == got[i][0, 0, 0])[0]
        assert (got[i] == big[z : z + 6, y : y + 6, x : x + 6]).all()
        corners.add((int(z), int(y), int(x)))
    assert len(corners) > 20 and np.allclose(got[31], exact)
    again = {x.id: x.v for x in splicing.cropped(wanted.repartition(5), held.repartition(7), EDGE, 6).collect()}
    assert all((np.ravel(got[i]) == again[i]).all() for i in got)


def test_loaded_volumes_are_scanned_no_more(spark, tmp_path):
    """The files go after the first use; the next uses still see the volumes, and what was held is let go."""
    v = np.random.default_rng(1).normal(5, 2, (16, 8, 8))
    as_chunks(spark, {1: v, 2: np.ones((8, 8, 8))}).write.parquet(f"file://{tmp_path}/v")
    with sliding.loaded(spark.read.parquet(f"file://{tmp_path}/v"), "run", EDGE) as ready:
        assert ready.count() == 3
        shutil.rmtree(tmp_path / "v")
        flat = chunks.flat(ready.where("run = 1"), "run", EDGE).collect()
        got = np.zeros(v.shape)
        for x in flat:
            got[x.z, x.y, x.x] = x.v
        assert np.allclose(got, (v - v.mean()) / v.std())
        assert ready.where("run = 2").select(F.explode("v").alias("v")).where("v IS NOT NULL").count() == 0
        assert ready.storageLevel.useMemory
    assert not ready.storageLevel.useMemory
