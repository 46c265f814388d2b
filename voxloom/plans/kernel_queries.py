"""Queries over dense kernels, fits and jobs. SQL has no FFT, labelling or spline; tests compare these with numpy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxloom.operators import augment, chunks, geometry, jobs, kernels, spatial, volume
from voxloom.plans.analysis_queries import SMOOTHED, fourier_sql
from voxloom.plans.spatial_queries import _free, _layers
from voxloom.plans.volume_queries import _edge
from voxloom.sources import model, storage
from voxloom.sources.model import SIDE, SPACING, with_views
from voxloom.streaming.classes import running_distribution


#: A Fourier augmentation's share of dropped frequencies, phase noise, and range of scales.
FOURIER = (0.3, 0.1, (0.8, 1.2))


def _flat(f, *a, **k):
    return lambda spark, d: volume.flat(f(model.samples(spark, d), SIDE, *a, **k))


def _augmented(spark, d):
    """The whole chain of augmentations, each behind its own gate."""
    return volume.flat(augment.pipeline(model.samples(spark, d), SIDE, FOURIER))


def _set(spark, d):
    """Chunks that are 1 where the mask is set."""
    return model.chunks(spark, d).withColumn("v", F.transform("v", lambda x: (x > 0.1).cast("double")))


def _components(spark, d):
    labelled = chunks.flat(chunks.components(_set(spark, d), "run", SIDE), "run", SIDE)
    return labelled.where("v > 0").select("run", "z", "y", "x", F.col("v").cast("long").alias("component"))


def _largest(spark, d):
    return geometry.component_stats(_components(spark, d)).where("largest").drop("largest")


def _spline(spark, d):
    return kernels.spline_lattice(kernels.spline_fit(_layers(spark, d), 50.0, 63.0), 3, 4).withColumn("z", F.round("z", 3))


def _slab_from_picks(spark, d):
    """Two coupled surfaces for each run, and the reason where there are too few points."""
    fits = kernels.spline_fit(_layers(spark, d), 50.0, 63.0)
    return fits.select("run", "n", "error", F.round(F.col("top") - F.col("bottom"), 3).alias("thickness"))


def _slab_from_segmentation(spark, d):
    mask = _components(spark, d)
    best = geometry.component_stats(mask).where("largest").select("run", "component")
    surface = geometry.surface_points(mask.join(best, ["run", "component"]), SPACING)
    place = [(F.col(a) * SPACING).alias(a) for a in "xy"]
    points = surface.select("run", F.lit("top").alias("layer"), *place, F.col("top").alias("z")).unionByName(surface.select("run", F.lit("bottom").alias("layer"), *place, F.col("bottom").alias("z")))
    return kernels.spline_lattice(kernels.spline_fit(points, 70.0, 70.0, 4), 3, 3, 4).withColumn("z", F.round("z", 3))


def _membrane(spark, d):
    """Normalise, predict over mirrored copies with a linear model, average, threshold."""
    weights = [1.0 + (i % 5) / 10 for i in range(SIDE**3)]
    scored = volume.tta_average(volume.zscore(model.samples(spark, d)), SIDE, weights)
    return scored.select("sample_id", F.size(F.filter("v", lambda x: x > 0.5)).alias("set"))


def _blobs(spark, d):
    """Smoothed local maxima above a level, as picks in angstrom."""
    smooth = chunks.rounded(volume.blurred(model.chunks(spark, d), "run", SIDE, model.EXTENT, 1.0), 9)
    peaks = chunks.flat(volume.local_maxima(smooth, "run", SIDE), "run", SIDE).where("v > 0.02")
    return peaks.select("run", *[(F.col(a) * SPACING).alias(a) for a in "xyz"])


def _rescaled(spark, d):
    rows = chunks.rescaled(model.chunks(spark, d), "run", SIDE, 10.0, 13.3)
    return rows.select("run", "d", "h", "w", ((F.col("z") * F.col("h") + F.col("y")) * F.col("w") + F.col("x")).alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _cache(spark, d):
    path = f"{storage.shared_folder(spark)}/voxloom-cache-{uuid.uuid4().hex}"
    df = storage.cached(spark, path, lambda: model.samples(spark, d))
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _tasks(spark, d):
    tasks = model.table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_totalprice").alias("price"))

    def work(rate, rows):
        ids = rows["task_id"].to_numpy()
        bad = ids[ids % 10 == 0]
        if len(bad):
            raise ValueError(f"no price for {bad[0]}")
        return rows["price"] * rate

    return jobs.run_tasks(tasks, lambda: 0.5, work, 8).select("task_id", "success", "error", F.round("result", 4).alias("result"))


def _with_background(spark, d):
    from voxloom.plans.spatial_queries import _spread

    return spatial.boxes(spatial.background(_spread(spark, d), model.EXTENT, 4, 2.0, 1.5).withColumn("point_id", F.col("attempt")), 4, model.EXTENT).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "bandpass_fft": lambda spark, d: _flat(kernels.bandpass, 1.5, 0.5, 0.5, 0.5)(spark, d).withColumn("v", F.col("v") + F.lit(0.0)),
    "fourier_augment": _flat(kernels.fourier_augment),
    "rotate_arbitrary": lambda spark, d: _flat(kernels.rotate, 30.0)(spark, d).withColumn("v", F.col("v") + F.lit(0.0)),
    "fourier_rescale": _rescaled,
    "augment_pipeline": _augmented,
    "connected_components": _components,
    "largest_component": _largest,
    "spline_fit": _spline,
    "slab_from_picks": _slab_from_picks,
    "slab_from_segmentation": _slab_from_segmentation,
    "membrane_pipeline": _membrane,
    "blob_detector": _blobs,
    "cache_roundtrip": _cache,
    "task_pool": _tasks,
    "background_boxes": _with_background,
    "streaming_class_distribution": lambda spark, d: running_distribution(model.table(spark, d, "events").select("ts", "event_type")),
}

REACHED = (
    "RECURSIVE n AS (SELECT run, z, y, x, row_number() OVER (PARTITION BY run ORDER BY z, y, x) AS n FROM voxels WHERE v > 0.1), "
    "e AS (SELECT a.run, a.n AS a, b.n AS b FROM n a JOIN n b ON a.run = b.run AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), "
    "r AS (SELECT run, n, n AS m FROM n UNION SELECT r.run, r.n, e.b FROM r JOIN e ON r.run = e.run AND r.m = e.a), "
    "f AS (SELECT run, z, y, x, min(m) AS first FROM r JOIN n USING (run, n) GROUP BY ALL), "
    "c AS (SELECT run, z, y, x, dense_rank() OVER (PARTITION BY run ORDER BY first) AS component FROM f) "
)
LABELLED = f"WITH {REACHED.replace('RECURSIVE n', f'RECURSIVE voxels AS ({model.SQL["voxels"]}), n', 1)}"

#: The band-pass as a periodic convolution: its taps are the cosine transform of the mask.
TAPS = (
    "m AS (SELECT z - 2 AS z, y - 2 AS y, x - 2 AS x, sqrt(((z - 2) * (z - 2) + (y - 2) * (y - 2) + (x - 2) * (x - 2))::DOUBLE) AS r FROM range(4) a(z), range(4) b(y), range(4) c(x)), "
    f"w AS (SELECT z, y, x, {_edge(1.5, 0.5)} * (1 - {_edge(0.5, 0.5)}) AS w FROM m), "
    "h AS (SELECT t.z AS z, t.y AS y, t.x AS x, avg(w * cos(pi() / 2 * (w.z * t.z + w.y * t.y + w.x * t.x))) AS h FROM w, (SELECT z, y, x FROM range(4) a(z), range(4) b(y), range(4) c(x)) t GROUP BY ALL) "
)

#: Where a place turned by 30 degrees comes from, and the weights of the four voxels around it.
TURNED = (
    "t AS (SELECT y, x, cos(radians(30)) * (y - 2) + sin(radians(30)) * (x - 2) + 2 AS sy, -sin(radians(30)) * (y - 2) + cos(radians(30)) * (x - 2) + 2 AS sx FROM range(4) a(y), range(4) b(x)), "
    "w AS (SELECT y, x, floor(sy)::INT + p AS fy, floor(sx)::INT + q AS fx, abs(1 - p - (sy - floor(sy))) * abs(1 - q - (sx - floor(sx))) AS w FROM t, range(2) c(p), range(2) d(q)) "
)
#: Maxima of a smoothed volume.
PEAKS = (
    "SELECT run, x * 10.0::DOUBLE AS x, y * 10.0::DOUBLE AS y, z * 10.0::DOUBLE AS z FROM (SELECT run, z - a AS z, y - b AS y, x - c AS x, max(v) AS top, max(v) FILTER (a = 0 AND b = 0 AND c = 0) AS v "
    f"FROM {SMOOTHED}, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) w(c) GROUP BY 1, 2, 3, 4) WHERE v = top AND v > 0.02"
)

ORACLE_SQL = {
    "rotate_arbitrary": with_views(f"+ {TURNED} SELECT i.sample_id, g.z * 16 + w.y * 4 + w.x AS i, round(coalesce(sum(w * s.v), 0), 6) + 0.0::DOUBLE AS v FROM (SELECT DISTINCT sample_id FROM sample_voxels) i, range(4) g(z), w "
    "LEFT JOIN sample_voxels s ON s.sample_id = i.sample_id AND s.z = g.z AND s.y = fy AND s.x = fx GROUP BY i.sample_id, g.z, w.y, w.x", "sample_voxels"),
    "fourier_rescale": with_views(f"SELECT run, 6 AS d, 6 AS h, 6 AS w, (z * 6 + y) * 6 + x AS i, round(v, 6) + 0.0::DOUBLE AS v FROM {fourier_sql(8, 6)}", "voxels"),
    "blob_detector": with_views(PEAKS, "voxels"),
    "background_boxes": with_views(f"SELECT 'valid' AS status, count(*) AS n FROM {_free(True)}", "picks"),
    "bandpass_fft": with_views(
        f"+ {TAPS} SELECT sample_id, ((s.z + h.z) % 4) * 16 + ((s.y + h.y) % 4) * 4 + (s.x + h.x) % 4 AS i, round(sum(s.v * h), 6) + 0.0::DOUBLE AS v FROM sample_voxels s, h GROUP BY 1, 2", "sample_voxels"
    ),
    "membrane_pipeline": with_views(
        "+ t AS (SELECT z, y, x, avg(1.0::DOUBLE + (((CASE WHEN m & 1 = 1 THEN 3 - z ELSE z END) * 16 + (CASE WHEN m & 2 = 2 THEN 3 - y ELSE y END) * 4 + (CASE WHEN m & 4 = 4 THEN 3 - x ELSE x END)) % 5) / 10.0::DOUBLE) AS t FROM range(4) a(z), range(4) b(y), range(4) c(x), range(8) d(m) GROUP BY 1, 2, 3), "
        "s AS (SELECT sample_id, z, y, x, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6) AS v FROM sample_voxels WINDOW w AS (PARTITION BY sample_id)) "
        'SELECT sample_id, count(*) FILTER (v * t > 0.5) AS "set" FROM s JOIN t USING (z, y, x) GROUP BY 1',
        "sample_voxels",
    ),
    "connected_components": LABELLED + "SELECT * FROM c",
    "largest_component": LABELLED
    + "SELECT run, component, area, cz, cy, cx FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY area DESC, component) AS k FROM (SELECT run, component, count(*) AS area, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM c GROUP BY 1, 2)) WHERE k = 1",
    "task_pool": "SELECT o_orderkey AS task_id, o_orderkey % 10 <> 0 AS success, CASE WHEN o_orderkey % 10 = 0 THEN 'ValueError: no price for ' || o_orderkey END AS error, CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice * 0.5::DOUBLE, 4) END AS result FROM orders",
    "cache_roundtrip": "SELECT CASE WHEN label = 0 THEN '-1' ELSE label::VARCHAR END AS key, count(*) AS n FROM embeddings GROUP BY 1",
    "streaming_class_distribution": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
