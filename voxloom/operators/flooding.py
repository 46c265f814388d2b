"""Watershed by flooding from markers: a minimum spanning forest over volumes in chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import chunks as c
from voxloom.sources import storage

WEIGHT = "w struct<hi: double, hi_at: bigint, lo: double, lo_at: bigint>"
FORWARD = ((0, 0, 1), (0, 1, 0), (1, 0, 0))


def _place(at: np.ndarray, edge: int, index: np.ndarray) -> np.ndarray:
    """The place, as a number above 0, of voxels given by their index over all chunks of a batch."""
    chunk, inner = np.divmod(index, edge**3)
    z, y, x = (at[chunk, k] * edge + k_ for k, k_ in enumerate(np.unravel_index(inner, (edge,) * 3)))
    return ((z << 2 * c.BITS) | (y << c.BITS) | x) + 1


def _weights(v: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.StructArray:
    """Weights of edges between voxels of heights v, w at places p, q: the one flooded later comes first."""
    later = (v < w) | ((v == w) & (p > q))
    columns = [-np.where(later, v, w), np.where(later, p, q), -np.where(later, w, v), np.where(later, q, p)]
    return pa.StructArray.from_arrays([pa.array(x) for x in columns], ["hi", "hi_at", "lo", "lo_at"])


def _attached(inside: np.ndarray, terminal: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each voxel the terminal it is flooded with, -1 for none, from edges (a, b) in order of weight; and the edges that
    are left between voxels of different terminals.

    In rounds, all parts without a terminal join along their least edge, as in any minimum spanning forest. Parts with a
    terminal stay, so no part gets two."""
    part, has, left = np.arange(len(inside)), terminal.copy(), np.arange(len(a))
    while True:
        pa_, pb = part[a[left]], part[b[left]]
        left = left[pa_ != pb]
        pa_, pb = part[a[left]], part[b[left]]
        ends, others = np.concatenate([pa_, pb]), np.concatenate([pb, pa_])
        order = np.concatenate([np.arange(len(left))] * 2)
        asks = np.flatnonzero(~has[ends])
        if not len(asks):
            break
        asks = asks[np.lexsort((order[asks], ends[asks]))]
        asks = asks[np.concatenate([[True], np.diff(ends[asks]) > 0])]
        to = np.arange(len(inside))
        to[ends[asks]] = others[asks]
        mutual = (to[to] == np.arange(len(to))) & (np.arange(len(to)) < to)
        to[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(to[to], to):
            to = to[to]
        part = to[part]
    return np.where(inside & has[part], part, -1), left


def _within(chunks: DataFrame, key: str, edge: int, least: float) -> DataFrame:
    """Chunks whose v has the place of the voxel's terminal (0 for none), with links between terminals and the markers."""
    side = np.indices((edge,) * 3)
    face = ((side == 0) | (side == edge - 1)).any(0)

    def ragged(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def run(batches):
        for whole in batches:
            step = max(1, c.HELD // (8 * edge**3))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                at, v, m = c._places(batch), c._cubes(batch.column("v"), edge, edge, edge), c._cubes(batch.column("m"), edge, edge, edge)
                n, index = len(v), np.arange(v.size).reshape(v.shape)
                inside = np.nan_to_num(v, nan=-np.inf) > least
                marked = inside & (np.nan_to_num(m) > 0)
                terminal = inside & (marked | face)
                pairs = [(index[:, : edge - z, : edge - y, : edge - x], index[:, z:, y:, x:]) for z, y, x in FORWARD]
                a, b = (np.concatenate([p[k].reshape(-1) for p in pairs]) for k in (0, 1))
                inside, terminal, flat = inside.reshape(-1), terminal.reshape(-1), v.reshape(-1)
                both = inside[a] & inside[b]
                a, b = a[both], b[both]
                rank = np.empty(v.size, np.int64)
                rank[np.lexsort((np.arange(v.size), -np.nan_to_num(flat, nan=-np.inf)))] = np.arange(v.size)
                order = np.lexsort((np.minimum(rank[a], rank[b]), np.maximum(rank[a], rank[b])))
                a, b = a[order], b[order]
                part, left = _attached(inside, terminal, a, b)
                a, b = a[left], b[left]
                met = np.flatnonzero((part[a] >= 0) & (part[b] >= 0))
                low, high = np.minimum(part[a], part[b])[met], np.maximum(part[a], part[b])[met]
                met = met[np.sort(np.unique(low * v.size + high, return_index=True)[1])]
                met = met[np.argsort(a[met] // edge**3, kind="stable")]
                places = _place(at, edge, np.arange(v.size))
                links = pa.StructArray.from_arrays([pa.array(places[part[x[met]]]) for x in (a, b)] + [_weights(flat[a[met]], flat[b[met]], places[a[met]], places[b[met]])], ["a", "b", "w"])
                own = np.flatnonzero(marked.reshape(-1))
                marks = pa.StructArray.from_arrays([pa.array(places[own]), pa.array(m.reshape(-1)[own].astype(np.int64))], ["node", "label"])
                value = np.where(np.isnan(flat), np.nan, np.where(part >= 0, places[part], 0)).reshape(v.shape)
                per_chunk = lambda x: np.bincount(x // edge**3, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(x) for x in (key, "cz", "cy", "cx")], c._lists(value), ragged(links, per_chunk(a[met])), ragged(marks, per_chunk(own))], [key, "cz", "cy", "cx", "v", "links", "marks"]
                )

    schema = f"{c._kind(chunks, key)}, v array<double>, links array<struct<a: bigint, b: bigint, {WEIGHT.replace(' struct', ': struct', 1)}>>, marks array<struct<node: bigint, label: bigint>>"
    return chunks.select(key, "cz", "cy", "cx", F.col("v").cast("array<double>"), F.col("m").cast("array<double>")).mapInArrow(run, schema)


def _across(chunks: DataFrame, key: str, edge: int, least: float) -> DataFrame:
    """key, a, b, w for neighbours in different chunks."""
    def met(padded: np.ndarray, at: np.ndarray, keys) -> pa.RecordBatch:
        core, found = c.shifted(padded, 1, (0, 0, 0)), []
        for axis, o in zip((2, 1, 0), FORWARD, strict=True):
            other = c.shifted(padded, 1, o)
            last = np.indices((edge,) * 3)[axis] == edge - 1
            index = np.flatnonzero(((np.nan_to_num(core, nan=-np.inf) > least) & (np.nan_to_num(other, nan=-np.inf) > least) & last).reshape(-1))
            step = 1 << c.BITS * (2 - axis)
            p = _place(at, edge, index)
            found.append((index // edge**3, p, p + step, core.reshape(-1)[index], other.reshape(-1)[index]))
        row, p, q, v, w = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(p), pa.array(q), _weights(v, w, p, q)], [key, "a", "b", "w"])

    return c.with_halo(chunks, key, edge, 1, None, f"{key} {chunks.schema[key].dataType.simpleString()}, a bigint, b bigint, {WEIGHT}", met)


def _forest(links: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, root) for nodes above 0: the node below 0 that floods it, or one above 0 where none reaches it.

    Nodes below 0 are roots. In rounds, the others follow their least link; a pair that follows each other keeps its smaller
    node. Their number at least halves in each round, which is written."""
    now, links = storage.written(nodes.withColumn("root", F.col("node")), "flood-nodes"), storage.written(links, "flood-links")
    while True:
        both = links.unionByName(links.select(key, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        steps = storage.written(both.where("a > 0").groupBy(key, "a").agg(F.min_by("b", "w").alias("b")), "flood-steps")
        back = steps.select(key, F.col("a").alias("b"), F.col("b").alias("a"))
        taken = steps.join(back.where("b > a"), [key, "a", "b"], "left_anti")
        if not taken.limit(1).count():
            return now
        ends = storage.written(c.followed(taken, key), "flood-ends")
        end = lambda x: ends.select(key, F.col("a").alias(x), F.col("b").alias(f"_{x}"))
        moved = links.join(end("a"), [key, "a"], "left").join(end("b"), [key, "b"], "left").select(key, *[F.coalesce(f"_{x}", x).alias(x) for x in "ab"], "w")
        kept = moved.where("a <> b AND (a > 0 OR b > 0)").groupBy(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
        after = storage.written(kept, "flood-links")
        further = storage.written(now.join(end("root"), [key, "root"], "left").select(key, "node", F.coalesce("_root", "root").alias("root")), "flood-nodes")
        for old in (steps, links, now, ends):
            storage.removed(old)
        now, links = further, after


def flooded(chunks: DataFrame, key: str, edge: int, least: float) -> DataFrame:
    """Watershed of chunks (key, cz, cy, cx, v, m): voxels above `least` get the label, above 0, of the marker m that floods
    them, falling from high v to low; 0 where no marker reaches or nothing is above `least`, NaN beyond the volume.

    Neighbours share a face. Voxels are ordered by height, the highest first, of equal ones by z, y, x; a link between two
    is as late as the later one, of equally late ones as the other. A voxel belongs to the marker it hangs on in the least
    spanning forest of all links, which is what a flood gives that always takes the earliest link next. So plateaus are
    divided in a defined way. Voxels of one label flood together, wherever they are. An empty table gives no rows.

    A chunk attaches its inner voxels to those on its faces and to markers, which is final. Links between these, and across
    faces, are a graph of at most the voxels on faces and their links, which is contracted in rounds; no task holds more
    than a batch of chunks."""
    within = storage.written(_within(chunks, key, edge, least), "flood-within")
    marks = within.select(key, F.explode("marks").alias("x")).select(key, "x.*")
    links = within.select(key, F.explode("links").alias("x")).select(key, "x.*").unionByName(_across(chunks, key, edge, least))
    of = lambda x: F.when(F.col(f"_{x}").isNull(), F.col(x)).otherwise(-F.col(x)).alias(x)
    known = lambda x: marks.select(key, F.col("node").alias(x), F.lit(True).alias(f"_{x}"))
    signed = links.join(known("a"), [key, "a"], "left").join(known("b"), [key, "b"], "left").select(key, of("a"), of("b"), "w").where("a > 0 OR b > 0")
    terminals = within.select(key, "cz", "cy", "cx", F.explode(F.array_distinct("v")).alias("node")).where("node > 0 AND NOT isnan(node)").withColumn("node", F.col("node").cast("long"))
    terminals = storage.written(terminals, "flood-terminals")
    plain = terminals.select(key, "node").join(marks, [key, "node"], "left_anti")
    roots = _forest(signed, plain, key).where("root < 0").select(key, "node", (-F.col("root")).alias("root"))
    labels = roots.join(marks.withColumnRenamed("node", "root"), [key, "root"]).select(key, "node", "label").unionByName(marks)
    named = terminals.join(labels, [key, "node"]).groupBy(key, "cz", "cy", "cx").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("names"))

    def run(batches):
        for batch in batches:
            cubes, out = c._cubes(batch.column("v"), edge, edge, edge), []
            for cube, names in zip(cubes, batch.column("names"), strict=True):
                label = np.zeros(cube.shape)
                if names.is_valid and len(names.values):
                    nodes, values = (np.asarray(names.values.field(x)) for x in ("node", "label"))
                    of_cube = np.nan_to_num(cube).astype(np.int64)
                    i = np.minimum(np.searchsorted(nodes, of_cube), len(nodes) - 1)
                    label = np.where(nodes[i] == of_cube, values[i], 0).astype(float)
                out.append(np.where(np.isnan(cube), np.nan, label))
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in (key, "cz", "cy", "cx")], c._lists(np.stack(out))], [key, "cz", "cy", "cx", "v"])

    return within.select(key, "cz", "cy", "cx", "v").join(named, [key, "cz", "cy", "cx"], "left").mapInArrow(run, f"{c._kind(chunks, key)}, v array<double>")


def maxima_as_markers(chunks: DataFrame, key: str, edge: int, least: float) -> DataFrame:
    """The chunks with m: maxima of a 3x3x3 neighbourhood above `least`, numbered by component."""
    from voxloom.operators.volume import local_maxima

    tops = local_maxima(chunks, key, edge).withColumn("v", F.transform("v", lambda x: F.when(F.isnan(x) | (x <= least), 0.0).otherwise(1.0)))
    numbered = c.components(tops, key, edge).withColumnRenamed("v", "m")
    return chunks.join(numbered, [key, "cz", "cy", "cx"])
