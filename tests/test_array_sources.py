"""Array stores and image files as data sources: what is read back, what is opened, and what a failed job leaves."""

import gzip
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_fourier import as_chunks, as_volume
from voxloom.sources import arrays, nifti

EDGE = 4


@pytest.fixture
def volumes():
    r = np.random.default_rng(1)
    return {i: r.normal(size=s).astype(np.float32) for i, s in enumerate([(9, 8, 5), (4, 4, 4), (3, 12, 7)])}


def test_store_is_read_as_it_was_written(spark, volumes, tmp_path):
    path = f"file://{tmp_path}/store"
    arrays.write_arrays(as_chunks(spark, volumes, EDGE), path, EDGE, 10.0, "wbp")
    found = arrays.read_arrays(spark, path)
    rows = arrays.as_chunks(found, EDGE).collect()
    for i, a in volumes.items():
        assert np.array_equal(as_volume([x for x in rows if x.run == str(i)], EDGE), a)
    assert {(x.run, x.voxel_spacing, x.tomo_type, x.level, x.scale, x.nz, x.ny, x.nx) for x in found.collect()} == {(str(i), 10.0, "wbp", 0, 10.0, *a.shape) for i, a in volumes.items()}
    with pytest.raises(Exception, match="is there"):
        arrays.write_arrays(as_chunks(spark, {1: volumes[1]}, EDGE), path, EDGE, 10.0, "wbp")
    arrays.write_arrays(as_chunks(spark, {1: volumes[1] * 2}, EDGE), path, EDGE, 10.0, "wbp", mode="overwrite")
    again = arrays.as_chunks(arrays.read_arrays(spark, path).where("run = '1'"), EDGE).collect()
    assert np.array_equal(as_volume(again, EDGE), volumes[1] * 2)


def test_filters_keep_other_folders_closed(spark, volumes, tmp_path):
    path = f"{tmp_path}/store"
    arrays.write_arrays(as_chunks(spark, volumes, EDGE), path, EDGE, 10.0, "wbp")
    arrays.write_arrays(as_chunks(spark, volumes, EDGE), path, EDGE, 20.0, "wbp")
    arrays.write_arrays(as_chunks(spark, {1: volumes[1]}, EDGE), path, EDGE, 10.0, "wbp", level=1)
    for folder, _, names in os.walk(path):  # whatever else is opened breaks the query
        if ".zarray" in names and not folder.endswith("1/VoxelSpacing10.000/wbp.zarr/0"):
            with open(f"{folder}/.zarray", "w") as f:
                f.write("broken")
    found = arrays.read_arrays(spark, path)
    rows = found.where("run = '1' AND voxel_spacing = 10.0 AND level = 0").collect()
    assert len(rows) == 1 and np.array_equal(np.reshape(rows[0].v, (4, 4, 4)), volumes[1])
    assert found.where(F.col("run").isin("1", "nowhere") & (F.col("voxel_spacing") == 10.0) & (F.col("level") == 0)).count() == 1
    assert found.where("run = 'nowhere'").count() == 0
    with pytest.raises(Exception, match="JSONDecodeError|Expecting value"):
        found.where("run = '1' AND voxel_spacing = 10.0").count()


def test_trees_of_others(spark, tmp_path):
    """Arrays named data, other orders, separators and compressors, missing chunks, levels with and without scales."""
    import zlib

    import zstandard

    group = tmp_path / "run a/VoxelSpacing7.84/denoised.zarr"
    a = np.arange(6 * 5 * 4).reshape(6, 5, 4)

    def array(name, dtype, order, separator, compressor, squeeze, missing=()):
        (group / name).mkdir(parents=True)
        meta = {"zarr_format": 2, "shape": a.shape, "chunks": [4, 4, 4], "dtype": dtype, "compressor": compressor, "fill_value": 7, "order": order, "filters": None, "dimension_separator": separator}
        (group / name / ".zarray").write_text(json.dumps(meta))
        whole = np.zeros((8, 8, 4), dtype)
        whole[:6, :5] = a
        for z, y in np.ndindex(2, 2):
            if (z, y) not in missing:
                file = group / name / separator.join(map(str, (z, y, 0)))
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(squeeze(whole[4 * z : 4 * z + 4, 4 * y : 4 * y + 4].tobytes(order)))

    array("data", ">i2", "F", "/", {"id": "zlib", "level": 1}, zlib.compress)
    array("0", "<f4", "C", ".", {"id": "blosc"}, bytes)  # data comes first
    array("1", "<f8", "C", ".", {"id": "zstd"}, zstandard.ZstdCompressor().compress, {(1, 1)})
    array("2", "|u1", "C", ".", None, bytes)
    (group / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "1", "coordinateTransformations": [{"type": "scale", "scale": [15.0, 15.0, 15.0]}]}]}]}))
    (tmp_path / "empty run").mkdir()
    got = {}
    for x in arrays.read_arrays(spark, str(tmp_path)).collect():
        got.setdefault((x.level, x.scale), np.zeros(a.shape))[x.cz * 4 : x.cz * 4 + x.d, x.cy * 4 : x.cy * 4 + x.h] = np.reshape(x.v, (x.d, x.h, x.w))
    holed = a.copy()
    holed[4:, 4:] = 7
    assert set(got) == {(0, 7.84), (1, 15.0), (2, 7.84 * 4)}
    assert np.array_equal(got[0, 7.84], a) and np.array_equal(got[1, 15.0], holed) and np.array_equal(got[2, 7.84 * 4], a)
    (group / "data/.zarray").unlink()
    (group / "data").rename(group / "gone")
    with pytest.raises(Exception, match="blosc"):
        arrays.read_arrays(spark, str(tmp_path)).where("level = 0").collect()


def test_failed_write_leaves_no_array(spark, volumes, tmp_path):
    path = f"{tmp_path}/store"
    with pytest.raises(ValueError, match="missing"):
        arrays.write_arrays(as_chunks(spark, volumes, EDGE, without={(0, (1, 0, 0))}), path, EDGE, 10.0, "wbp")
    given = as_chunks(spark, volumes, EDGE).withColumn("v", F.when(F.col("run") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    keys = [F.col("run").cast("string").alias("run"), F.lit(10.0).alias("voxel_spacing"), F.lit("wbp").alias("tomo_type"), F.lit(0).alias("level"), F.lit(10.0).alias("scale")]
    rows = given.select(*keys, *[F.lit(4).alias(n) for n in ("nz", "ny", "nx")], "cz", "cy", "cx", *[F.lit(4).alias(n) for n in "dhw"], F.col("v").cast("array<double>").alias("v"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("arrays").mode("append").option("path", path).option("edge", EDGE).save()
    assert arrays.read_arrays(spark, path).count() == 0


def test_training_set(spark, volumes, tmp_path):
    images = as_chunks(spark, volumes, EDGE)
    masks = as_chunks(spark, {i: (a > 0.5).astype(np.float32) for i, a in volumes.items() if i != 1}, EDGE)
    names = {"background": 0, "particle": 1}
    test = spark.createDataFrame([(2,)], "run long")
    nifti.write_training_set(images, masks, str(tmp_path), EDGE, 7.84, names, test)
    left = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert left == ["dataset.json", "imagesTr/0_0000.nii.gz", "imagesTs/2_0000.nii.gz", "labelsTr/0.nii.gz"]
    assert json.loads((tmp_path / "dataset.json").read_text()) == {"channel_names": {"0": "cryo-ET"}, "labels": names, "file_ending": ".nii.gz", "numTraining": 1}
    data = gzip.decompress((tmp_path / "imagesTr/0_0000.nii.gz").read_bytes())
    assert len(data) == 352 + volumes[0].size * 4 and data[344:348] == b"n+1\0"
    assert struct.unpack_from("<i", data)[0] == 348 and struct.unpack_from("<4h", data, 40) == (3, 5, 8, 9) and struct.unpack_from("<2h", data, 70) == (16, 32)
    assert np.allclose(struct.unpack_from("<4f", data, 76), (1, 0.784, 0.784, 0.784)) and struct.unpack_from("<f", data, 108)[0] == 352
    got, spacing = nifti.parsed((tmp_path / "imagesTr/0_0000.nii.gz").read_bytes())
    assert np.array_equal(got, volumes[0]) and abs(spacing - 0.784) < 1e-6
    label = nifti.parsed((tmp_path / "labelsTr/0.nii.gz").read_bytes())[0]
    assert label.dtype == np.uint8 and np.array_equal(label, volumes[0] > 0.5)
    found = {x.file: np.reshape(x.v, (x.d, x.h, x.w)) for x in nifti.read_files(spark, str(tmp_path)).collect()}
    assert len(found) == 3 and np.array_equal(found["imagesTs/2_0000.nii.gz"], volumes[2])


def test_failed_set_has_no_dataset_file(spark, volumes, tmp_path):
    rows = nifti.file_rows(as_chunks(spark, volumes, EDGE), EDGE, F.concat(F.lit("imagesTr/"), F.col("run").cast("string"), F.lit(".nii.gz")), "float32", 10.0)
    for broken in (rows.where("NOT (file = 'imagesTr/0.nii.gz' AND cz = 1 AND cy = 0 AND cx = 0)"), rows.where("NOT (file = 'imagesTr/0.nii.gz' AND cz = 2)")):
        with pytest.raises(Exception, match="voxels are missing"):
            nifti.write_files(broken, str(tmp_path), {"labels": {}})
        assert [f for _, _, fs in os.walk(tmp_path) for f in fs if not f.startswith(".")] == []
    nifti.write_files(rows, str(tmp_path), {"labels": {}})
    assert (tmp_path / "dataset.json").exists() and nifti.read_files(spark, str(tmp_path)).count() == 3
