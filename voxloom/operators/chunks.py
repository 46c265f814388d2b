"""Volumes as chunks: dense cubes of one edge, z slowest, in rows (key, cz, cy, cx, v); NaN where the volume has no voxel.

Work that looks beyond a chunk gets a halo: each chunk sends the slabs that its neighbours need, so what is shuffled are
arrays, one for each chunk and neighbour, never voxels, and no task holds more than some padded chunks. numpy works on all
chunks of a batch at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import number
from voxloom.sources import storage

#: Elements of the padded chunks that are held at once, about: a step has some tens of arrays of this size. Links between
#: labels that a task contracts at once.
HELD, LINKS = 500_000, 200_000
#: Bits of each coordinate in a voxel's place, which orders voxels by z, y, x and fits a double.
BITS = 17

Change = Callable[[np.ndarray, np.ndarray], np.ndarray]


def chunked(voxels: DataFrame, key: str, edge: int) -> DataFrame:
    """Chunks from voxel rows (key, z, y, x, v), for volumes that come as such."""
    place = sum((F.pmod(F.col(a), F.lit(edge)) * edge ** (2 - k) for k, a in enumerate("zyx")), F.lit(0)).cast("int")
    of = [F.floor(F.col(a) / edge).cast("int").alias(f"c{a}") for a in "zyx"]
    held = voxels.groupBy(key, *of).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("i"), F.col("v").cast("double").alias("v")))).alias("m"))
    return held.select(key, "cz", "cy", "cx", F.transform(F.sequence(F.lit(0), F.lit(edge**3 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(float("nan")))).alias("v"))


def flat(chunks: DataFrame, key: str, edge: int, digits: int | None = None) -> DataFrame:
    """key, z, y, x, v: a row for each voxel of the chunks."""
    at = F.col("i")
    within = [F.floor(at / (edge * edge)), F.floor(at / edge) % edge, at % edge]
    rows = chunks.select(key, "cz", "cy", "cx", F.posexplode("v").alias("i", "v")).where(~F.isnan("v"))
    value = F.col("v") if digits is None else F.round("v", digits)
    return rows.select(key, *[(F.col(f"c{a}") * edge + w).cast("int").alias(a) for a, w in zip("zyx", within, strict=True)], value.alias("v"))


def rounded(chunks: DataFrame, digits: int) -> DataFrame:
    return chunks.withColumn("v", F.transform("v", lambda x: F.round(x, digits)))


def _kind(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, cz int, cy int, cx int"


def _cubes(column, *shape: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), *shape)


def _lists(arrays: np.ndarray) -> pa.Array:
    n = arrays[0].size if len(arrays) else 0
    return pa.ListArray.from_arrays(np.arange(0, n * len(arrays) + 1, max(n, 1), dtype=np.int32)[: len(arrays) + 1], pa.array(arrays.reshape(-1)))


def _places(batch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(f"c{a}"), dtype=np.int64) for a in "zyx"], 1)


def each(chunks: DataFrame, key: str, edge: int, change: Change) -> DataFrame:
    """The chunks after change(cubes, places), which takes and gives arrays of cubes; places are chunk coordinates."""
    def run(batches):
        for whole in batches:
            step = max(1, HELD // edge**3)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                out = change(_cubes(batch.column("v"), edge, edge, edge), _places(batch))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, "cz", "cy", "cx")], _lists(out.astype(float))], [key, "cz", "cy", "cx", "v"])

    return chunks.select(key, "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(run, f"{_kind(chunks, key)}, v array<double>")


def slabs(edge: int, width: int) -> list[tuple[tuple[int, int, int], tuple[slice, ...], tuple[slice, ...]]]:
    """For each neighbour at d: d, the part of it that is needed, and where that goes in the padded cube."""
    reach, out = -(-width // edge), []
    for d in product(range(-reach, reach + 1), repeat=3):
        ends = [(max(0, -width - c * edge), min(edge, edge + width - c * edge)) for c in d]
        if all(a < b for a, b in ends):
            out.append((d, tuple(slice(a, b) for a, b in ends), tuple(slice(c * edge + width + a, c * edge + width + b) for c, (a, b) in zip(d, ends, strict=True))))
    return out


def with_halo(chunks: DataFrame, key: str, edge: int, width: int, change: Change, schema: str = "v array<double>", rows: Callable | None = None) -> DataFrame:
    """Chunks after change(padded, places), where a padded cube has `width` voxels more on each side, NaN beyond the volume.

    change gives one cube for each chunk; or, with rows, rows(padded, places, keys) gives a record batch of any schema."""
    parts = slabs(edge, width)
    own = next(i for i, (d, _, _) in enumerate(parts) if d == (0, 0, 0))

    def send(batches):
        for batch in batches:
            cubes, at = _cubes(batch.column("v"), edge, edge, edge), _places(batch)
            for i, (d, needed, _) in enumerate(parts):
                to = at - np.array(d)
                columns = [pa.array(to[:, k].astype(np.int32)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *columns, pa.array(np.full(len(at), i, np.int32)), _lists(np.ascontiguousarray(cubes[(slice(None), *needed)]))], [key, "cz", "cy", "cx", "part", "v"])

    def receive(batches):
        side = edge + 2 * width
        for whole in batches:
            step = max(1, HELD // side**3)
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists = batch.column("parts")
                sizes, items = np.asarray(lists.value_lengths()), lists.flatten()
                row, part, values = np.repeat(np.arange(len(sizes)), sizes), np.asarray(items.field("part")), items.field("v")
                padded = np.full((len(sizes), side, side, side), np.nan)
                for i in np.unique(part):
                    here = np.flatnonzero(part == i)
                    into = parts[i][2]
                    shape = [s.stop - s.start for s in into]
                    block = np.asarray(values.take(pa.array(here)).flatten(), dtype=float).reshape(len(here), *shape)
                    padded[(row[here][:, None, None, None], *np.ix_(*[np.arange(s.start, s.stop) for s in into]))] = block
                if rows:
                    yield rows(padded, _places(batch), batch.column(key))
                else:
                    out = change(padded, _places(batch))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, "cz", "cy", "cx")], _lists(out.astype(float))], [key, "cz", "cy", "cx", "v"])

    sent = chunks.select(key, "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(send, f"{_kind(chunks, key)}, part int, v array<double>")
    held = sent.groupBy(key, "cz", "cy", "cx").agg(F.collect_list(F.struct("part", "v")).alias("parts"))
    there = held.where(F.exists("parts", lambda p: p["part"] == own))  # else the place is outside the volume
    return there.mapInArrow(receive, schema if rows else f"{_kind(chunks, key)}, v array<double>")


def shifted(padded: np.ndarray, width: int, offset: tuple[int, int, int]) -> np.ndarray:
    """The values at an offset from each voxel of the inner cubes."""
    return padded[(slice(None), *[slice(width + o, n - width + o) for o, n in zip(offset, padded.shape[1:], strict=True)])]


def over_offsets(chunks: DataFrame, key: str, edge: int, offsets: list[tuple[int, int, int]], how: np.ufunc) -> DataFrame:
    """how (np.fmin, np.fmax, ...) over the values at the offsets; places outside the volume are left out."""
    width = max(abs(c) for o in offsets for c in o)

    def change(padded: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = shifted(padded, width, offsets[0]).copy()
        for o in offsets[1:]:
            how(out, shifted(padded, width, o), out=out)
        return np.where(np.isnan(shifted(padded, width, (0, 0, 0))), np.nan, out)

    return with_halo(chunks, key, edge, width, change)


def forest(links: DataFrame, key: str) -> DataFrame:
    """(key, a, b) with a < b that connect the same labels as those of the task do: each label with the least it reaches
    among LINKS links, about, which a task contracts at once."""
    return links.select(key, "a", "b").mapInArrow(lambda batches: forested(batches, key), f"{key} {links.schema[key].dataType.simpleString()}, a long, b long")


def forested(batches, key: str):
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, LINKS):
            held.append(batch.slice(start, LINKS))
            n += held[-1].num_rows
            if n >= LINKS:
                yield _least(held, key)
                held, n = [], 0
    if n:
        yield _least(held, key)


def _least(batches: list, key: str) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    ends = np.stack([np.asarray(table.column(c)) for c in "ab"], 1)
    code = table.column(key).combine_chunks().dictionary_encode()
    of = np.asarray(code.indices, dtype=np.int64)
    nodes, at = np.unique(np.stack([np.repeat(of, 2), ends.reshape(-1)], 1), axis=0, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))  # nodes are sorted by key and label
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        for i in (a, b, root[a], root[b]):
            np.minimum.at(new, i, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(nodes[kept, 0])), pa.array(nodes[root[kept], 1]), pa.array(nodes[kept, 1])], [key, "a", "b"])


def contracted(links: DataFrame, key: str) -> DataFrame:
    """(key, label, root) for the labels of (key, a, b) that are not the least of those they are connected with.

    Tasks contract what they hold; then stars are formed by turns: a label's larger neighbours go to its least one, and its
    smaller ones too, until nothing moves. Rounds grow with the logarithm of the longest chain, each is written, and no task
    needs all links of a run."""
    now, was = storage.written(forest(links.where("a <> b").select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), key), "links"), None
    while True:
        at = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(key, "a", "b"))).first()
        if at == was or not at[0]:
            return now.select(key, F.col("b").alias("label"), F.col("a").alias("root"))
        was = at
        around = now.unionByName(now.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy(key, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, [key, "a"]).where("b > a").select(key, F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(key, "b").agg(F.min("a").alias("m"))
        small = large.join(low, [key, "b"]).where("a > m").select(key, F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(key, F.col("m").alias("a"), "b"))
        after = storage.written(small.distinct(), "links")
        storage.removed(now)
        now = after


def followed(steps: DataFrame, key: str) -> DataFrame:
    """(key, a, b) with b where a chain of steps from a ends: each round doubles how far a step reaches."""
    now = storage.written(steps, "steps")
    while True:
        on = now.select(key, F.col("a").alias("b"), F.col("b").alias("_on"))
        further = now.join(on, [key, "b"], "left").select(key, "a", F.coalesce("_on", "b").alias("b"), (F.coalesce("_on", "b") != F.col("b")).alias("_moved"))
        after = storage.written(further, "steps")
        storage.removed(now)
        now = after
        if not now.where("_moved").limit(1).count():
            return now.select(key, "a", "b")


def components(mask: DataFrame, key: str, edge: int) -> DataFrame:
    """Chunks whose voxels above 0 are labelled by 26-neighbour connection: 1, 2, ... in the order of each one's first
    voxel by z, y, x; 0 where nothing is set.

    Every chunk is labelled by itself; labels that touch across faces make a small graph, at most a row for each pair of
    touching parts, which is contracted, whatever the size of a run; a chunk then gets the numbers of its own few labels."""
    def place(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((z << 2 * BITS) | (y << BITS) | x) + 1

    def label(cubes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each voxel gets the place of its part's first voxel. Labels spread, and then jump to their label's label."""
        n, size = len(cubes), edge**3
        filled = np.zeros((n, edge + 2, edge + 2, edge + 2), bool)
        filled[:, 1:-1, 1:-1, 1:-1] = np.nan_to_num(cubes) > 0
        labels = np.full(filled.shape, size, np.int64)
        labels[:, 1:-1, 1:-1, 1:-1] = np.arange(size).reshape(edge, edge, edge)
        labels[~filled] = size
        row = np.arange(n)[:, None]
        while True:
            new = labels
            for axis in (1, 2, 3):
                new = np.minimum(new, np.minimum(np.roll(new, 1, axis), np.roll(new, -1, axis)))
            new = np.where(filled, new, size)
            inner = np.concatenate([new[:, 1:-1, 1:-1, 1:-1].reshape(n, size), np.full((n, 1), size)], 1)
            new[:, 1:-1, 1:-1, 1:-1] = inner[row, inner[:, :size]].reshape(cubes.shape)
            if (new == labels).all():
                break
            labels = new
        first = labels[:, 1:-1, 1:-1, 1:-1]
        z, y, x = (at[:, k, None, None, None] * edge + c for k, c in enumerate(np.unravel_index(np.minimum(first, size - 1), (edge,) * 3)))
        return np.where(np.isnan(cubes), np.nan, np.where(first < size, place(z, y, x), 0))

    def touching(padded: np.ndarray, _: np.ndarray, keys) -> pa.RecordBatch:
        core, pairs = np.nan_to_num(shifted(padded, 1, (0, 0, 0))), []
        row = np.broadcast_to(np.arange(len(core))[:, None, None, None], core.shape)
        for o in product((-1, 0, 1), repeat=3):
            if o > (0, 0, 0):
                other = np.nan_to_num(shifted(padded, 1, o))
                met = (core > 0) & (other > 0) & (core != other)
                pairs.append(np.stack([row[met], np.minimum(core[met], other[met]).astype(np.int64), np.maximum(core[met], other[met]).astype(np.int64)], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2])], [key, "a", "b"])

    kind = mask.schema[key].dataType.simpleString()
    labelled = each(mask, key, edge, label)
    links = with_halo(labelled, key, edge, 1, None, f"{key} {kind}, a long, b long", touching).distinct()
    roots = contracted(links, key)
    own = labelled.select(key, "cz", "cy", "cx", F.explode(F.array_distinct("v")).alias("v")).where("v > 0 AND NOT isnan(v)").select(key, "cz", "cy", "cx", F.col("v").cast("long").alias("label"))
    own = own.join(roots, [key, "label"], "left").withColumn("root", F.coalesce("root", "label"))
    numbers = number.numbered(own.select(key, "root").distinct(), [key], F.floor(F.col("root") / float(1 << 2 * BITS)), ["root"], "component")
    maps = own.join(numbers, [key, "root"]).groupBy(key, "cz", "cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("double"), F.col("component").cast("double")))).alias("m"))
    named = lambda x: F.when((x > 0) & ~F.isnan(x), F.element_at("m", x)).otherwise(x)
    return labelled.join(maps, [key, "cz", "cy", "cx"], "left").select(key, "cz", "cy", "cx", F.transform("v", named).alias("v"))


#: Columns of a piece but for its key and values: place, own size, and the volume's size along axes that are known.
PIECE = ("cz", "cy", "cx", "d", "h", "w", "nz", "ny", "nx")


def _ragged(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([a.reshape(-1) for a in arrays]) if arrays else np.empty(0)))


def _piece_schema(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, {', '.join(f'{c} int' for c in PIECE)}, re array<double>, im array<double>"


def _trimmed(batch, edge: int) -> tuple[list[np.ndarray], np.ndarray]:
    cubes = _cubes(batch.column("v"), edge, edge, edge)
    there = ~np.isnan(cubes)
    sizes = np.stack([there.any(axis=others).sum(1) for others in ((2, 3), (1, 3), (1, 2))], 1)
    return [cube[tuple(slice(0, n) for n in size)] for cube, size in zip(cubes, sizes.tolist(), strict=True)], sizes


def pieces(chunks: DataFrame, key: str, edge: int) -> DataFrame:
    """Chunks without the places beyond their volume, as key, PIECE, re and im; im is empty while all is real."""
    def run(batches):
        for whole in batches:
            step = max(1, HELD // edge**3)
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                cut, sizes = _trimmed(batch, edge)
                columns = [*_places(batch).T, *sizes.T, *[np.zeros(len(cut))] * 3]
                yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(x.astype(np.int32)) for x in columns], _ragged(cut), _ragged([np.empty(0)] * len(cut))], [key, *PIECE, "re", "im"])

    return chunks.select(key, "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(run, _piece_schema(chunks, key))


def extents(chunks: DataFrame, key: str, edge: int) -> DataFrame:
    """key, d, h, w, voxels and whole, whether every voxel within these sizes is there once: what a volume's chunks say."""
    def run(batches):
        for batch in batches:
            cut, sizes = _trimmed(batch, edge)
            ends = _places(batch) * edge + sizes
            filled = np.array([np.count_nonzero(~np.isnan(x)) for x in cut], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[batch.column(f"c{a}") for a in "zyx"], *[pa.array(x.astype(np.int32)) for x in ends.T], pa.array(filled)], [key, "cz", "cy", "cx", "d", "h", "w", "filled"])

    kind = f"{_kind(chunks, key)}, d int, h int, w int, filled long"
    each_one = chunks.select(key, "cz", "cy", "cx", F.col("v").cast("array<double>")).mapInArrow(run, kind)
    found = each_one.groupBy(key).agg(*[F.max(c).alias(c) for c in "dhw"], F.sum("filled").alias("voxels"), F.count(F.lit(1)).alias("_n"))
    volume = F.col("d").cast("long") * F.col("h") * F.col("w")
    grid = F.ceil(F.col("d") / edge) * F.ceil(F.col("h") / edge) * F.ceil(F.col("w") / edge)
    return found.select(key, "d", "h", "w", "voxels", ((F.col("voxels") == volume) & (F.col("_n") == grid)).alias("whole"))


def pencils(parts: DataFrame, key: str, edge: int, axis: int, change: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Pieces after change(x, n, start) along one axis of every volume, which may change its length and go over to complex.

    x holds all voxels along the axis, which comes first, and a chunk's along the other two; n the volume's sizes (0 for
    axes that no pass has seen), start the chunk's first place on the other axes. So pieces are shuffled to meet along the
    axis, and a task holds some columns of chunks, never a volume."""
    name = "zyx"[axis]
    rest = [k for k in range(3) if k != axis]

    def run(batches):
        for batch in batches:
            lists, out, held = batch.column("parts"), [], 0
            count = np.asarray(lists.value_lengths())
            ends, column = np.cumsum(count), dict(zip(["at", *PIECE[3:], "re", "im"], lists.flatten().flatten(), strict=True))
            at, numbers = np.asarray(column["at"]), np.stack([np.asarray(column[c], dtype=np.int64) for c in PIECE[3:]], 1)
            values = {c: (np.concatenate([[0], np.cumsum(np.asarray(column[c].value_lengths()))]), np.asarray(column[c].flatten())) for c in ("re", "im")}
            places = [np.asarray(batch.column(f"c{'zyx'[k]}")) for k in rest]

            def cube(i: int) -> np.ndarray:
                (a, re), (b, im) = values["re"], values["im"]
                x = re[a[i] : a[i + 1]]
                return (x + 1j * im[b[i] : b[i + 1]] if b[i] < b[i + 1] else x).reshape(numbers[i, :3])

            def batch_of(out: list) -> pa.RecordBatch:
                rows, numbers, arrays = zip(*out, strict=True)
                columns = [pa.array(x.astype(np.int32)) for x in np.array(numbers).T]
                parts = [_ragged([x.real for x in arrays]), _ragged([x.imag if np.iscomplexobj(x) else np.empty(0) for x in arrays])]
                return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), *columns, *parts], [key, *PIECE, "re", "im"])

            for k in range(len(count)):
                mine = np.arange(ends[k] - count[k], ends[k])
                mine = mine[np.argsort(at[mine])]
                whole = np.moveaxis(np.concatenate([cube(i) for i in mine], axis), axis, 0)
                n = numbers[mine[0], 3:].copy()
                n[axis] = n[axis] or len(whole)
                done = np.moveaxis(change(whole, n, np.array([p[k] for p in places]) * edge), 0, axis)
                for c in range(-(-done.shape[axis] // edge)):
                    part = done[tuple(slice(c * edge, (c + 1) * edge) if j == axis else slice(None) for j in range(3))]
                    place = [c if j == axis else int(places[rest.index(j)][k]) for j in range(3)]
                    out.append((k, [*place, *part.shape, *n], np.ascontiguousarray(part)))
                held += done.size
                if held > HELD // 4:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)

    own = F.struct(F.col(f"c{name}").alias("at"), *PIECE[3:], "re", "im")
    return parts.groupBy(key, *[f"c{'zyx'[k]}" for k in rest]).agg(F.collect_list(own).alias("parts")).mapInArrow(run, _piece_schema(parts, key))


def whole_chunks(parts: DataFrame, key: str, edge: int) -> DataFrame:
    """Chunks from the real parts of pieces, NaN beyond the volume."""
    def run(batches):
        for batch in batches:
            size = np.stack([np.asarray(batch.column(c)) for c in "dhw"], 1)
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("re").value_lengths()))])
            values, cubes = np.asarray(batch.column("re").flatten()), np.full((len(size), edge, edge, edge), np.nan)
            for i, (d, h, w) in enumerate(size.tolist()):
                cubes[i, :d, :h, :w] = values[ends[i] : ends[i + 1]].reshape(d, h, w)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, "cz", "cy", "cx")], _lists(cubes)], [key, "cz", "cy", "cx", "v"])

    return parts.select(key, "cz", "cy", "cx", "d", "h", "w", "re").mapInArrow(run, f"{_kind(parts, key)}, v array<double>")


def by_axis(chunks: DataFrame, key: str, edge: int, matrix: Callable[[int], np.ndarray]) -> DataFrame:
    """A linear map that is a product of one matrix for each axis: key, d, h, w (the volume's new size), z, y, x, v, a row
    for each voxel. matrix(n) is that for an axis of n voxels, real or complex; v is the real part."""
    now = pieces(chunks, key, edge)
    for axis in range(3):
        now = pencils(now, key, edge, axis, lambda x, n, _: np.tensordot(matrix(len(x)), x, (1, 0)))
    sizes = now.groupBy(key).agg(*[F.max(F.col(f"c{a}") * edge + F.col(n)).cast("int").alias(n) for a, n in zip("zyx", "dhw", strict=True)])
    rows = now.select(key, "cz", "cy", "cx", F.col("h").alias("ph"), F.col("w").alias("pw"), F.posexplode("re").alias("i", "v")).join(sizes, key)
    at = F.col("i")
    within = [F.floor(at / (F.col("ph") * F.col("pw"))), F.floor(at / F.col("pw")) % F.col("ph"), at % F.col("pw")]
    return rows.select(key, "d", "h", "w", *[(F.col(f"c{a}") * edge + x).cast("int").alias(a) for a, x in zip("zyx", within, strict=True)], "v")


def rescaled(chunks: DataFrame, key: str, edge: int, spacing: float, to: float) -> DataFrame:
    """Fourier cropping to a coarser spacing: even sizes, centred on the zero frequency, orthonormal both ways."""
    if to < spacing:
        raise ValueError("only coarser spacings")

    def matrix(n: int) -> np.ndarray:
        m = int(round(n * spacing / to))
        m -= m % 2
        f, j, i = np.arange(-(m // 2), m - m // 2), np.arange(m), np.arange(n)
        return np.exp(2j * np.pi * np.outer(j, f) / m) @ np.exp(-2j * np.pi * np.outer(f, i) / n) / np.sqrt(m * n)

    return by_axis(chunks, key, edge, matrix)


def resize_weights(n: int, to: int) -> np.ndarray:
    """(to, n): a Gaussian against aliasing where the axis shrinks, of sigma (n / to - 1) / 2, then linear interpolation at
    (i + 0.5) * n / to - 0.5; beyond the ends the axis is mirrored about its end voxels."""
    def at(i: np.ndarray) -> np.ndarray:
        period = max(1, 2 * n - 2)
        i = np.mod(i, period)
        return np.where(i < n, i, period - i)

    smooth = np.eye(n)
    sigma = max(0.0, (n / to - 1) / 2)
    if sigma:
        r = int(4.0 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        smooth = np.zeros((n, n))
        for k, x in zip(range(-r, r + 1), w / w.sum(), strict=True):
            np.add.at(smooth, (np.arange(n), at(np.arange(n) + k)), x)
    place = (np.arange(to) + 0.5) * n / to - 0.5
    low = np.floor(place).astype(int)
    linear = np.zeros((to, n))
    np.add.at(linear, (np.arange(to), at(low)), 1 - (place - low))
    np.add.at(linear, (np.arange(to), at(low + 1)), place - low)
    return linear @ smooth


def resized(chunks: DataFrame, key: str, edge: int, to: int) -> DataFrame:
    """Volumes resized to a cube, with reflection at the edges and against aliasing."""
    return by_axis(chunks, key, edge, lambda n: resize_weights(n, to))


def basins(chunks: DataFrame, key: str, edge: int, least: float) -> DataFrame:
    """Watershed by steepest ascent: chunks whose voxels above `least` hold the place of the top they climb to; 0 elsewhere.

    A voxel climbs to the highest of its 26 neighbours, of equal ones to the first by z, y, x, until none is higher. Chunks
    climb by themselves as far as they reach; the voxels where a climb leaves a chunk make a small table, at most the
    voxels of the chunks' faces, whose chains are followed by doubling. A top is numbered by its place, (z, y, x) in BITS bits each, + 1."""
    def place(z, y, x):
        return ((z << 2 * BITS) | (y << BITS) | x) + 1

    def climb(padded: np.ndarray, at: np.ndarray, _=None) -> np.ndarray:
        known = np.where(np.nan_to_num(padded, nan=-np.inf) > least, padded, -np.inf)
        core = shifted(known, 1, (0, 0, 0))
        best, step = core.copy(), np.zeros((*core.shape, 3), np.int64)
        grid = np.indices((edge,) * 3)
        z, y, x = (at[:, k, None, None, None] * edge + grid[k][None] for k in range(3))
        own = place(z, y, x)
        goal = own.copy()
        for o in product((-1, 0, 1), repeat=3):
            other = shifted(known, 1, o)
            to = place(z + o[0], y + o[1], x + o[2])
            better = (other > best) | ((other == best) & (to < goal) & np.isfinite(other))
            best, goal = np.where(better, other, best), np.where(better, to, goal)
            step[better] = o
        n, size = len(core), edge**3
        inner = np.stack([g[None] + step[..., k] for k, g in enumerate(grid)])
        inside = ((inner >= 0) & (inner < edge)).all(0)
        flat_to = np.where(inside, (np.clip(inner[0], 0, edge - 1) * edge + np.clip(inner[1], 0, edge - 1)) * edge + np.clip(inner[2], 0, edge - 1), np.arange(size).reshape((edge,) * 3)[None]).reshape(n, size)
        row = np.arange(n)[:, None]
        while True:  # a voxel whose next one lies outside stays where it is
            new = flat_to[row, flat_to]
            if (new == flat_to).all():
                break
            flat_to = new
        end = goal.reshape(n, size)[row, flat_to].reshape(core.shape)
        return np.where(np.isnan(shifted(padded, 1, (0, 0, 0))), np.nan, np.where(np.isfinite(core), end, 0))

    climbed = with_halo(chunks, key, edge, 1, climb)
    kind = chunks.schema[key].dataType.simpleString()
    low = (1 << BITS) - 1
    part = lambda p, k: F.shiftright(p - 1, BITS * (2 - k)).bitwiseAND(F.lit(low))
    ends = climbed.select(key, "cz", "cy", "cx", F.explode(F.array_distinct("v")).alias("v")).where("v > 0 AND NOT isnan(v)").select(key, "cz", "cy", "cx", F.col("v").cast("long").alias("end"))
    away = sum(((F.floor(part(F.col("end"), k) / edge) != F.col(f"c{a}")).cast("int") for k, a in enumerate("zyx")), F.lit(0)) > 0
    wanted = ends.where(away).select(key, "end").distinct()
    within = sum(((part(F.col("end"), k) % edge) * edge ** (2 - k) for k in range(3)), F.lit(0)).cast("int")
    home = [F.floor(part(F.col("end"), k) / edge).cast("int").alias(f"c{a}") for k, a in enumerate("zyx")]
    onward = wanted.select(key, "end", within.alias("i"), *home).join(climbed, [key, "cz", "cy", "cx"]).select(key, F.col("end").alias("a"), F.get("v", F.col("i")).cast("long").alias("b"))

    tops = followed(onward, key).select(key, F.col("a").alias("end"), F.col("b").alias("top"))
    maps = ends.where(away).join(tops, [key, "end"]).groupBy(key, "cz", "cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("end").cast("double"), F.col("top").cast("double")))).alias("m"))
    moved = lambda v: F.when(F.isnan(v), v).otherwise(F.coalesce(F.element_at("m", v), v))
    return climbed.join(maps, [key, "cz", "cy", "cx"], "left").select(key, "cz", "cy", "cx", F.transform("v", moved).alias("v"))
