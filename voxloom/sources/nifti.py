"""Volumes as NIfTI-1 files, and training sets of such files, as a Spark data sink that commits once.

Tasks stream their volumes slab by slab into files beside their places. When all tasks are through, the driver moves the
files there, and writes dataset.json last: a set that has it is whole, and a job that fails leaves neither."""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from voxloom.functions import text
from voxloom.operators import chunks
from voxloom.sources.arrays import NUMBERS, opened, put

SCHEMA = f"file string, dtype string, spacing double, edge int, {', '.join(f'{n} int' for n in NUMBERS)}, v array<double>"
#: Fixed values of the format: codes of the voxels' types.
CODES = {"uint8": 2, "int16": 4, "int32": 8, "float32": 16, "float64": 64}


def header(shape: tuple[int, int, int], spacing: float, dtype: str) -> bytes:
    """The 352 bytes before the voxels; shape is (z, y, x), and files have x fastest. Axes as in images whose directions are
    the identity: x and y point the other way in this format."""
    out = bytearray(352)
    struct.pack_into("<i", out, 0, 348)
    struct.pack_into("<8h", out, 40, 3, *shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", out, 70, CODES[dtype], np.dtype(dtype).itemsize * 8)
    struct.pack_into("<8f", out, 76, 1.0, spacing, spacing, spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", out, 108, 352.0, 1.0, 0.0)  # where voxels start; slope and intercept
    struct.pack_into("<2h", out, 252, 0, 1)  # the matrix below holds
    for i, sign in enumerate((-1, -1, 1)):
        struct.pack_into("<4f", out, 280 + 16 * i, *[sign * spacing * (k == i) for k in range(3)], 0.0)
    out[344:348] = b"n+1\0"
    return bytes(out)


def parsed(data: bytes) -> tuple[np.ndarray, float]:
    """The voxels (z, y, x) and the spacing of a file, gzipped or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    if len(data) < 352 or data[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 file")
    dim, (code, _), pixdim = struct.unpack_from("<8h", data, 40), struct.unpack_from("<2h", data, 70), struct.unpack_from("<8f", data, 76)
    dtype = next(k for k, v in CODES.items() if v == code)
    start = int(struct.unpack_from("<f", data, 108)[0])
    return np.frombuffer(data, dtype, int(np.prod(dim[1:4])), start).reshape(dim[3], dim[2], dim[1]), float(pixdim[1])


@dataclass
class Files(WriterCommitMessage):
    moves: list


class NiftiWriter(DataSourceArrowWriter):
    """Rows of one file must come together, ordered by cz: see write_files()."""

    def __init__(self, path: str, about: str | None):
        self.path, self.about = path, about

    def write(self, batches):
        store, path = opened(self.path)
        moves, now, out = [], None, None

        def flush() -> None:
            if now["slab"] is not None:
                if np.isnan(now["slab"]).any():
                    raise ValueError(f"{now['file']}: voxels are missing")
                out.write(now["slab"].astype(now["dtype"]).tobytes())
                now["done"] += len(now["slab"])
                now["slab"] = None

        def close() -> None:
            flush()
            out.close()
            if now["done"] != now["shape"][0]:
                raise ValueError(f"{now['file']}: voxels are missing")

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if now is None or now["file"] != r["file"]:
                        if now:
                            close()
                        shape = (r["nz"], r["ny"], r["nx"])
                        now = {"file": r["file"], "dtype": r["dtype"], "shape": shape, "slab": None, "cz": None, "done": 0}
                        folder, _, name = f"{path}/{r['file']}".rpartition("/")
                        store.create_dir(folder, recursive=True)
                        moves.append((f"{folder}/.{uuid.uuid4().hex}-{name}", f"{folder}/{name}"))
                        out = store.open_output_stream(moves[-1][0], compression="gzip" if name.endswith(".gz") else None)
                        out.write(header(shape, r["spacing"], r["dtype"]))
                    if now["cz"] != r["cz"]:
                        flush()
                        now |= {"cz": r["cz"], "slab": np.full((r["d"], *now["shape"][1:]), np.nan)}
                    y, x = r["cy"] * r["edge"], r["cx"] * r["edge"]
                    now["slab"][:, y : y + r["h"], x : x + r["w"]] = np.reshape(r["v"], (r["d"], r["h"], r["w"]))
            if now:
                close()
        except BaseException:
            if out:
                out.close()
            for beside, _ in moves:
                store.delete_file(beside)
            raise
        return Files(moves)

    def commit(self, messages) -> None:
        store, path = opened(self.path)
        moves = [x for m in messages if m for x in m.moves]
        for beside, place in moves:
            store.move(beside, place)
        if self.about:
            about = json.loads(self.about)
            about["numTraining"] = sum("/labelsTr/" in place for _, place in moves)
            put(store, f"{path}/dataset.json", json.dumps(about, indent=4).encode())

    def abort(self, messages) -> None:
        store, _ = opened(self.path)
        for beside, _ in [x for m in messages if m for x in m.moves]:
            store.delete_file(beside)


class Nifti(DataSource):
    """Option about: the fields of dataset.json but for numTraining, as JSON; without it none is written."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NiftiWriter:
        return NiftiWriter(self.options["path"], self.options.get("about"))


def file_rows(volumes: DataFrame, edge: int, file, dtype: str, spacing: float) -> DataFrame:
    """Rows for write_files() from chunks (run, cz, cy, cx, v); file is a column of the file's name."""
    own = chunks.extents(volumes, "run", edge).select("run", *[F.col(n).alias(f"n{a}") for a, n in zip("zyx", "dhw", strict=True)])
    parts = chunks.pieces(volumes, "run", edge).drop("nz", "ny", "nx", "im").join(own, "run")
    return parts.select(file.alias("file"), F.lit(dtype).alias("dtype"), text.nanometres(F.lit(float(spacing))).alias("spacing"), F.lit(edge).alias("edge"), *NUMBERS, F.col("re").alias("v"))


def write_files(rows: DataFrame, path: str, about: dict | None = None) -> None:
    """Files of SCHEMA's rows. A file's rows are dealt to one task in the order of their slabs, of which it holds one."""
    spark = rows.sparkSession
    spark.dataSource.register(Nifti)
    ordered = rows.repartition("file").sortWithinPartitions("file", "cz", "cy", "cx")
    writer = ordered.write.format("nifti").mode("append").option("path", path)
    (writer.option("about", json.dumps(about)) if about else writer).save()


def write_training_set(images: DataFrame, labels: DataFrame, path: str, edge: int, spacing: float, label_names: dict[str, int], test: DataFrame | None = None) -> DataFrame:
    """imagesTr, labelsTr and imagesTs with dataset.json; runs without an image or without labels are left out.

    images and labels are chunks by run, test has the runs that are not trained on. Returns run, file of what was meant to
    be written."""
    has = lambda df: df.select("run").distinct()
    held_out = has(test) if test is not None else has(images).limit(0)
    train = has(images).join(has(labels), "run").join(held_out, "run", "left_anti")
    case = text.case_id(F.col("run").cast("string"))
    named = lambda folder, end: F.concat(F.lit(f"{folder}/"), case, F.lit(end))
    parts = [
        (images.join(train, "run", "left_semi"), named("imagesTr", "_0000.nii.gz"), "float32"),
        (labels.join(train, "run", "left_semi"), named("labelsTr", ".nii.gz"), "uint8"),
        (images.join(held_out, "run", "left_semi"), named("imagesTs", "_0000.nii.gz"), "float32"),
    ]
    rows = [file_rows(df, edge, file, dtype, spacing) for df, file, dtype in parts]
    about = {"channel_names": {"0": "cryo-ET"}, "labels": label_names, "file_ending": ".nii.gz"}
    write_files(rows[0].unionByName(rows[1]).unionByName(rows[2]), path, about)
    files = [has(df).select("run", file.alias("file")) for df, file, _ in parts]
    return files[0].unionByName(files[1]).unionByName(files[2])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file (below the path), d, h, w, spacing and v of all files: whole volumes in a row, for small ones."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii.gz").option("recursiveFileLookup", "true").load(path)

    def decode(batches):
        for batch in batches:
            got = [parsed(c) for c in batch.column("content").to_pylist()]
            sizes = [pa.array([a.shape[k] for a, _ in got], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), *sizes, pa.array([s for _, s in got]), pa.array([a.astype(float).ravel() for a, _ in got], pa.list_(pa.float64()))], ["file", "d", "h", "w", "spacing", "v"])

    named = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file")
    return found.select(named, "content").mapInArrow(decode, "file string, d int, h int, w int, spacing double, v array<double>")
