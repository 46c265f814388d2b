"""Chunked array stores (Zarr, version 2) as a Spark data source: groups of one array for each level of a volume.

    spark.dataSource.register(ArrayStore)
    spark.read.format("arrays").load(path).where("run = 'a' AND voxel_spacing = 10.0 AND level = 0")

A store is a tree <path>/<run>/VoxelSpacing<spacing>/<type>.zarr/<array>/. Level 0 is the array `data` if there is one, else
`0`; level k is `k`. A partition reads a range of one array's chunks, and equality filters on run, voxel_spacing, tomo_type and
level are pushed down (spark.sql.python.filterPushdown.enabled must be true): folders of other runs aren't listed, nor their
metadata opened. Paths may be of any store that Arrow's file systems know.

Writing puts chunks into the tasks' arrays; an array's metadata comes last, when all tasks are through, and without it there
is no array for a reader. A job that fails leaves no array. Arrays that exist are refused, or replaced in mode overwrite.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from voxloom.operators import chunks

KEYS = ("run", "voxel_spacing", "tomo_type", "level")
NUMBERS = ("nz", "ny", "nx", "cz", "cy", "cx", "d", "h", "w")
SCHEMA = f"run string, voxel_spacing double, tomo_type string, level int, scale double, {', '.join(f'{n} int' for n in NUMBERS)}, v array<double>"
#: Bytes of voxels that a partition reads, about.
PARTITION_BYTES = 64_000_000
SPACING = re.compile(r"^VoxelSpacing(\d+(?:\.\d+)?)$")


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return arrow_fs.FileSystem.from_uri(path)


def names_in(store: arrow_fs.FileSystem, folder: str) -> list[str]:
    return sorted(x.base_name for x in store.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)) if x.type == arrow_fs.FileType.Directory)


def content(store: arrow_fs.FileSystem, path: str) -> bytes | None:
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def put(store: arrow_fs.FileSystem, path: str, data: bytes) -> None:
    """A file that is whole once it is there."""
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as f:
        f.write(data)
    store.move(beside, path)


def decompressed(data: bytes, how: dict | None) -> bytes:
    if how is None:
        return data
    if how["id"] == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    known = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}
    if how["id"] not in known:
        raise ValueError(f"chunks are compressed by {how['id']}, which can't be read here")
    return known[how["id"]](data)


@dataclass
class Range(InputPartition):
    """Chunks first..end of one array, counted in the order of their places."""

    folder: str
    meta: dict
    keys: tuple
    scale: float
    first: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in KEYS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def asked(self, key: str, value) -> bool:
        return key not in self.wanted or value in self.wanted[key]

    def runs(self, store, path: str) -> list[str]:
        if "run" not in self.wanted:
            return names_in(store, path)
        return sorted(r for r in self.wanted["run"] if r is not None)

    def arrays(self, store, group: str):
        """(level, folder, metadata) of a group's arrays."""
        held = names_in(store, group)
        for level, name in sorted({0: "data" if "data" in held else "0", **{int(x): x for x in held if x.isdigit() and int(x)}}.items()):
            meta = content(store, f"{group}/{name}/.zarray") if self.asked("level", level) and name in held else None
            if meta is not None:
                yield level, f"{group}/{name}", json.loads(meta)

    def partitions(self):
        store, path = opened(self.path)
        out = []
        for run in self.runs(store, path):
            for folder in names_in(store, f"{path}/{run}"):
                found = SPACING.match(folder)
                if not found or not self.asked("voxel_spacing", float(found[1])):
                    continue
                for group in names_in(store, f"{path}/{run}/{folder}"):
                    tomo_type = group.removesuffix(".zarr")
                    if tomo_type == group or not self.asked("tomo_type", tomo_type):
                        continue
                    place = f"{path}/{run}/{folder}/{group}"
                    scales = self.scales(store, place)
                    for level, array, meta in self.arrays(store, place):
                        n = int(np.prod([-(-s // c) for s, c in zip(meta["shape"], meta["chunks"], strict=True)]))
                        step = max(1, PARTITION_BYTES // (8 * int(np.prod(meta["chunks"]))))
                        keys, name = (run, float(found[1]), tomo_type, level), array.rpartition("/")[2]
                        scale = scales.get(name, keys[1] * 2**level)
                        out += [Range(array, meta, keys, scale, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    @staticmethod
    def scales(store, group: str) -> dict[str, float]:
        """By array the size of a voxel along the slowest axis, where the group's attributes tell it."""
        attributes = json.loads(content(store, f"{group}/.zattrs") or b"{}")
        out = {}
        for x in (attributes.get("multiscales") or [{}])[0].get("datasets", []):
            scale = [t["scale"] for t in x.get("coordinateTransformations", []) if t.get("type") == "scale"]
            out |= {x["path"]: float(scale[0][0])} if scale else {}
        return out

    def read(self, part: Range | None):
        if part is None:  # there are no arrays
            return
        store, _ = opened(self.path)
        meta, shape, size = part.meta, np.array(part.meta["shape"]), np.array(part.meta["chunks"])
        if len(shape) != 3 or meta.get("filters"):
            raise ValueError(f"{part.folder}: arrays of three axes without filters are read")
        grid, dtype = -(-shape // size), np.dtype(meta["dtype"])
        for i in range(part.first, part.end):
            at = np.array(np.unravel_index(i, grid))
            data = content(store, f"{part.folder}/{meta.get('dimension_separator', '.').join(map(str, at))}")
            if data is None:
                cube = np.full(size, meta.get("fill_value") or 0, dtype)
            else:
                cube = np.frombuffer(decompressed(data, meta.get("compressor")), dtype).reshape(size, order=meta.get("order", "C"))
            there = np.minimum(size, shape - at * size)
            v = np.ascontiguousarray(cube[tuple(slice(0, n) for n in there)], dtype=float).ravel()
            numbers = [pa.array([int(x)], pa.int32()) for x in (*shape, *at, *there)]
            run, spacing, tomo_type, level = part.keys
            keys = [pa.array([run]), pa.array([spacing]), pa.array([tomo_type]), pa.array([level], pa.int32()), pa.array([part.scale])]
            yield pa.RecordBatch.from_arrays([*keys, *numbers, pa.array([v], pa.list_(pa.float64()))], [*KEYS, "scale", *NUMBERS, "v"])


@dataclass
class Written(WriterCommitMessage):
    arrays: list


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, edge: int, dtype: str, data: str, overwrite: bool):
        self.path, self.edge, self.dtype, self.data, self.overwrite = path, edge, dtype, data, overwrite

    def folder(self, path: str, run: str, spacing: float, tomo_type: str, level: int) -> str:
        return f"{path}/{run}/VoxelSpacing{spacing:.3f}/{tomo_type}.zarr/{self.data if level == 0 else level}"

    def write(self, batches):
        store, path = opened(self.path)
        seen: dict[str, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                keys = tuple(r[k] for k in KEYS)
                folder, shape = self.folder(path, *keys), [r["nz"], r["ny"], r["nx"]]
                if folder not in seen:
                    if content(store, f"{folder}/.zarray") is not None:
                        if not self.overwrite:
                            raise FileExistsError(f"{folder} is there; mode overwrite replaces it")
                        store.delete_file(f"{folder}/.zarray")
                    seen[folder] = (keys, shape)
                cube = np.zeros((self.edge,) * 3, self.dtype)
                d, h, w = r["d"], r["h"], r["w"]
                cube[:d, :h, :w] = np.reshape(r["v"], (d, h, w))
                put(store, f"{folder}/{r['cz']}.{r['cy']}.{r['cx']}", zlib.compress(cube.tobytes(), 1))
        return Written(list(seen.items()))

    def commit(self, messages) -> None:
        store, path = opened(self.path)
        arrays = {folder: x for m in messages if m for folder, x in m.arrays}
        for folder, (keys, shape) in sorted(arrays.items()):
            group, _, name = folder.rpartition("/")
            known = json.loads(content(store, f"{group}/.zattrs") or b"{}").get("multiscales", [{"version": "0.4", "name": keys[2], "datasets": []}])
            scale = {"type": "scale", "scale": [keys[1] * 2 ** keys[3]] * 3}
            rest = [x for x in known[0]["datasets"] if x["path"] != name]
            known[0]["datasets"] = sorted([*rest, {"path": name, "coordinateTransformations": [scale]}], key=lambda x: x["coordinateTransformations"][0]["scale"][0])
            put(store, f"{group}/.zgroup", b'{"zarr_format": 2}')
            put(store, f"{group}/.zattrs", json.dumps({"multiscales": known}).encode())
            meta = {"zarr_format": 2, "shape": shape, "chunks": [self.edge] * 3, "dtype": np.dtype(self.dtype).str, "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "C", "filters": None}
            put(store, f"{folder}/.zarray", json.dumps(meta).encode())

    def abort(self, messages) -> None:
        """Chunks without their array's metadata are nothing to a reader; the next write replaces them."""


class ArrayStore(DataSource):
    """Options for writing: edge (of a chunk), dtype (float32), array0 (the name of level 0's array: 0, or data)."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], int(self.options.get("edge", 64)), self.options.get("dtype", "float32"), self.options.get("array0", "0"), overwrite)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """All arrays of a store, by SCHEMA. Turns on the pushing of filters into Python sources, which the reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayStore)
    return spark.read.format("arrays").load(path)


def as_chunks(arrays: DataFrame, edge: int) -> DataFrame:
    """run, cz, cy, cx, v as the operators take them, from arrays whose chunks have that edge."""
    return chunks.whole_chunks(arrays.withColumn("re", F.col("v")), "run", edge)


def write_arrays(volumes: DataFrame, path: str, edge: int, spacing: float, tomo_type: str, level: int = 0, mode: str = "append", dtype: str = "float32", array0: str = "0") -> None:
    """Chunks (run, cz, cy, cx, v) as arrays. Volumes that lack voxels are refused before anything is written."""
    spark = volumes.sparkSession
    spark.dataSource.register(ArrayStore)
    sizes = chunks.extents(volumes, "run", edge)
    broken = sizes.where("NOT whole").select("run").first()
    if broken:
        raise ValueError(f"voxels of run {broken[0]} are missing")
    own = sizes.select("run", *[F.col(n).alias(f"n{a}") for a, n in zip("zyx", "dhw", strict=True)])
    parts = chunks.pieces(volumes, "run", edge).drop("nz", "ny", "nx", "im").join(own, "run")
    keys = [F.col("run").cast("string").alias("run"), F.lit(float(spacing)).alias("voxel_spacing"), F.lit(tomo_type).alias("tomo_type"), F.lit(level).alias("level"), F.lit(float(spacing * 2**level)).alias("scale")]
    rows = parts.select(*keys, *NUMBERS, F.col("re").alias("v"))
    rows.write.format("arrays").mode(mode).option("path", path).option("edge", edge).option("dtype", dtype).option("array0", array0).save()
