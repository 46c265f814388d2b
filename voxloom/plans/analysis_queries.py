"""Detection in whole volumes, resizing, spectra, and what is stored and read again, with SQL for each."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.functions.rng import uniform_sql
from voxloom.operators import augment, catalog, chunks, dataset, fourier, geometry, jobs, kernels, volume
from voxloom.plans.spatial_queries import CENTRED, MEANS, TOP, _layers, _plane
from voxloom.plans.volume_queries import FLAT, PAIRS
from voxloom.sources import model, storage
from voxloom.sources.model import EXTENT, SIDE, SPACING, with_views

SIGMA, LEVEL, SMALLER = 1.0, 0.02, 5


def _smooth(spark, d):
    return chunks.rounded(volume.blurred(model.chunks(spark, d), "run", SIDE, EXTENT, SIGMA), 9)


def _basins(spark, d):
    """run, z, y, x, top: every voxel above the level with the place of the top it belongs to."""
    rows = chunks.flat(chunks.basins(_smooth(spark, d), "run", SIDE, LEVEL), "run", SIDE).where("v > 0")
    part = lambda k: F.shiftright(F.col("v").cast("long") - 1, chunks.BITS * (2 - k)).bitwiseAND(F.lit((1 << chunks.BITS) - 1))
    top = (part(0) * EXTENT + part(1)) * EXTENT + part(2)
    return rows.select("run", "z", "y", "x", top.cast("int").alias("top"))


def _watershed_picks(spark, d):
    """The centroids of the basins as picks in angstrom."""
    centre = _basins(spark, d).groupBy("run", "top").agg(*[(F.avg(a) * SPACING).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("voxels"))
    return centre.select("run", *[F.round(a, 6).alias(a) for a in "xyz"], "voxels")


def _response(spark, d):
    return chunks.flat(volume.response_mask(model.chunks(spark, d), "run", SIDE, SIGMA), "run", SIDE).select("run", "z", "y", "x", F.col("v").cast("int").alias("label"))


def _resized(spark, d):
    rows = chunks.resized(model.chunks(spark, d), "run", SIDE, SMALLER)
    return rows.select("run", "z", "y", "x", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _spectrum(spark, d):
    return fourier.log_spectrum(model.chunks(spark, d), "run", SIDE).withColumn("v", F.round("v", 5))


def _beta(alpha):
    def run(spark, d):
        s = model.samples(spark, d)
        pairs = volume.mixup_partners(s).withColumn("lam", augment.beta("beta", alpha, "sample_id"))
        return volume.flat(volume.mixup(s, pairs))

    return run


def _folder(spark, name):
    return f"{storage.shared_folder(spark)}/voxloom-{name}-{uuid.uuid4().hex}"


def _sizes(spark, d):
    part = model.table(spark, d, "part")
    return part.select(F.col("p_partkey").cast("long").alias("run"), (F.col("p_size") + 8).alias("d"), (F.col("p_partkey") % 30 + 20).cast("int").alias("h"), F.lit(40).alias("w"))


def _dataset(spark, d):
    """Samples of all volumes are saved and bound, when loaded, to the first volume of the same size."""
    path = _folder(spark, "dataset")
    line = model.table(spark, d, "lineitem")
    samples = line.select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("run"), F.col("l_returnflag").alias("key"))
    storage.save_dataset(samples, _sizes(spark, d), {"boxsize": [SIDE] * 3, "voxel_spacing": SPACING}, path)
    loaded, metadata = storage.load_dataset(spark, path, _sizes(spark, d))
    return loaded.select("sample_id", "run", "key", F.lit(metadata["voxel_spacing"]).alias("spacing"))


def _sets(spark, d):
    """Two sets for each object; the second write replaces those of one user and adds those of another."""
    path = _folder(spark, "sets")
    picks = model.picks(spark, d).select("point_id", "x", F.col("run").cast("string").alias("run"), "object_name")
    keyed = lambda user, rows: rows.withColumn("user_id", F.lit(user)).withColumn("session_id", F.lit("1"))
    storage.write_sets(keyed("a", picks).unionByName(keyed("b", picks)), path)
    storage.write_sets(keyed("b", picks.where(F.col("x") < EXTENT * SPACING / 2)).unionByName(keyed("c", picks)), path)
    return storage.read_sets(spark, path).groupBy("object_name", F.col("user_id").cast("string").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"))


def _mesh(spark, d):
    runs = _layers(spark, d).select("run").distinct()
    at = geometry.lattice(geometry.plane_fit(_layers(spark, d).where("layer = 'top'")), 5, 4, 50.0, 63.0)
    both = at.unionByName(at.withColumn("z", F.col("z") - 100.0))
    return storage.write_mesh(both, geometry.mesh(runs, 5, 4), _folder(spark, "mesh"))


def _by_name(spark, d):
    part = model.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("run"), F.col("p_size").cast("double").alias("voxel_spacing"))
    both = part.unionByName(part.withColumn("voxel_spacing", F.col("voxel_spacing") + 7.5))
    return catalog.segmentations_by_name(both, 12.0)


def _labels(spark, d):
    """Every brand stores a table of its targets: the kinds of its objects, numbered in order."""
    kinds = F.array_sort(F.collect_set("p_type"))
    stored = model.table(spark, d, "part").groupBy(F.col("p_brand").alias("config")).agg(kinds.alias("k"))
    return catalog.label_map(stored.select("config", F.map_from_arrays("k", F.sequence(F.lit(1), F.size("k"))).alias("labels")), "config")


def _fallback(spark, d):
    found = model.table(spark, d, "part").select(F.col("p_partkey").alias("run"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_size").cast("double"))).alias("data"), F.array(F.lit(0.0)).alias("0"))
    return storage.volume_arrays(found, ["data", "0"]).select("run", F.get("v", 0).alias("first"))


def _job(i):
    def run(spark, d):
        wanted = model.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("run"), F.concat(F.lit("wbp-"), "s_suppkey").alias("name"))
        return jobs.filter_volumes(wanted, model.chunks(spark, d), SIDE, 10.0, 20.0)[i]

    return run


def _downsampled(spark, d):
    return _job(0)(spark, d).select("run", "z", "y", "x", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _slab(method):
    return lambda spark, d: kernels.slab(_layers(spark, d), method, 50.0, 63.0, 3, 4).withColumn("z", F.round("z", 3))


def _pick_counts(spark, d):
    return kernels.spline_fit(_layers(spark, d), 50.0, 63.0).select("run", "n", "error")


def _overlap_planes(spark, d):
    set_ = model.chunks(spark, d).withColumn("v", F.transform("v", lambda x: (x > 0.1).cast("double")))
    found = kernels.planes_by_overlap(set_, SIDE)
    return found.select("run", *[F.round(c, 4).alias(c) for c in ("nz", "ny", "nx", "top", "bottom", "iou")])


QUERIES = {
    "watershed_basins": _basins,
    "watershed_picks": _watershed_picks,
    "response_mask": _response,
    "resize_whole": _resized,
    "log_spectrum": _spectrum,
    "mixup_beta": _beta(2),
    "mixup_beta_fractional": _beta(0.2),
    "dataset_roundtrip": _dataset,
    "sets_replaced": _sets,
    "mesh_written": _mesh,
    "segmentation_by_name": _by_name,
    "target_labels": _labels,
    "spacing_nm": lambda spark, d: model.tomograms(spark, d).select("ord", text.nanometres(F.col("voxel_spacing")).alias("nm")),
    "array_fallback": _fallback,
    "positive_frequencies": lambda spark, d: model.table(spark, d, "part").select("p_partkey", F.posexplode(volume.positive_frequencies(F.col("p_size"), 10.0)).alias("k", "f")).withColumn("f", F.round("f", 9)),
    "downsample_volumes": _downsampled,
    "downsample_jobs": _job(1),
    "slab_parallel": _slab("parallel"),
    "slab_spline": _slab("spline"),
    "slab_overlap": _overlap_planes,
    "slab_pick_counts": _pick_counts,
    "sphere_volume": lambda spark, d: dataset.sphere_volumes(model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("run")), 16, 12),
}


def _table(rows, *names):
    return "(VALUES " + ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + f") t({', '.join(names)})"


def _along(source: str, weights: str) -> str:
    """Weights (j, i, w) along z, then y, then x of (run, z, y, x, v)."""
    z = f"(SELECT run, j AS z, y, x, sum(v * w) AS v FROM {source} s JOIN {weights} ON s.z = i GROUP BY ALL)"
    y = f"(SELECT run, z, j AS y, x, sum(v * w) AS v FROM {z} s JOIN {weights} ON s.y = i GROUP BY ALL)"
    return f"(SELECT run, z, y, j AS x, sum(v * w) AS v FROM {y} s JOIN {weights} ON s.x = i GROUP BY ALL)"


BLUR = _table([(a, b, w) for a, b, w in volume.kernel(EXTENT, SIGMA)], "j", "i", "w")
SMOOTHED = f"(SELECT run, z, y, x, round(v, 9) AS v FROM {_along('voxels', BLUR)})"
#: Each voxel above the level with the highest place next to it, of equals the first.
CLIMB = (
    f"b AS (SELECT *, (z * 8 + y) * 8 + x AS n FROM {SMOOTHED}), "
    f"p AS (SELECT a.run, a.n, arg_max(c.n, (c.v, -c.n)) AS up FROM b a JOIN b c ON a.run = c.run AND abs(a.z - c.z) <= 1 AND abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1 WHERE a.v > {LEVEL} AND c.v > {LEVEL} GROUP BY 1, 2), "
    "w AS (SELECT run, n, up, 0 AS k FROM p UNION ALL SELECT w.run, w.n, p.up, k + 1 FROM w JOIN p ON w.run = p.run AND w.up = p.n WHERE p.up <> p.n), "
    "t AS (SELECT run, n, arg_max(up, k) AS top FROM w GROUP BY 1, 2) "
)


def _recursive(sql: str) -> str:
    return with_views(f"+ {CLIMB}{sql}", "voxels").replace("WITH ", "WITH RECURSIVE ", 1)


LINE = _table([(j, i, math.exp(-0.5 * ((i - j) / SIGMA) ** 2) / (2 * math.pi * SIGMA * SIGMA) ** (1 / 3)) for j in range(EXTENT) for i in range(max(0, j - 2), min(EXTENT, j + 3))], "j", "i", "w")
RESIZE = _table([(j, i, float(w)) for j, row in enumerate(chunks.resize_weights(EXTENT, SMALLER)) for i, w in enumerate(row) if w], "j", "i", "w")


def fourier_sql(n: int, m: int, source: str = "voxels", out: str = "*") -> str:
    """Fourier cropping of n-cubes to m-cubes by sums of cosines and sines, one axis after another."""
    angle = f"2 * pi() * f * (j / {m}.0::DOUBLE - i / {n}.0::DOUBLE)"
    weights = f"(SELECT j, i, sum(cos({angle})) / sqrt({n * m}) AS c, sum(sin({angle})) / sqrt({n * m}) AS s FROM range({m}) a(j), range({n}) b(i), range({-(m // 2)}, {m - m // 2}) q(f) GROUP BY 1, 2)"
    z = f"(SELECT run, j AS z, y, x, sum(v * c) AS re, sum(v * s) AS im FROM {source} u JOIN {weights} w ON u.z = w.i GROUP BY ALL)"
    y = f"(SELECT run, z, j AS y, x, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM {z} u JOIN {weights} w ON u.y = w.i GROUP BY ALL)"
    return f"(SELECT run, z, y, j AS x, sum(re * c - im * s) AS v FROM {y} u JOIN {weights} w ON u.x = w.i GROUP BY ALL)"


def _positive(name: str) -> str:
    text = f"'beta-' || s || '-{name}' || '|' || sample_id::VARCHAR"
    return f"(1 - ('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: Two draws of Gamma(0.2) for each sample: exponential ones times the first accepted share of 24 pairs.
GAMMA = (
    "gt AS (SELECT q.*, k, " + ", ".join(f"pow({_positive(x).replace(f'-{x}', f'-{x}' + chr(39) + ' || k || ' + chr(39))}, {e}) AS {x}" for x, e in (("u", 1 / 0.2), ("w", 1 / (1 - 0.2)))) + " FROM q, range(24) r(k)), "
    "ga AS (SELECT sample_id, s, arg_min(u / (u + w), k) AS share FROM gt WHERE u + w <= 1 AND u + w > 0 GROUP BY 1, 2), "
    f"gc AS (SELECT sample_id, s, -ln({_positive('rest')}) * share AS g FROM ga), "
    "gb AS (SELECT sample_id, max(g) FILTER (s = 'g') AS g, max(g) FILTER (s = 'h') AS h FROM gc GROUP BY 1)"
)


def spectrum_sql(n: int, source: str = "voxels") -> str:
    """The Fourier transform of n-cubes, one axis after another."""
    turn = f"(SELECT j, i, cos(2 * pi() * j * i / {n}) AS c, -sin(2 * pi() * j * i / {n}) AS s FROM range({n}) a(j), range({n}) b(i))"
    z = f"(SELECT run, j AS z, y, x, sum(v * c) AS re, sum(v * s) AS im FROM {source} u JOIN {turn} w ON u.z = w.i GROUP BY ALL)"
    y = f"(SELECT run, z, j AS y, x, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM {z} u JOIN {turn} w ON u.y = w.i GROUP BY ALL)"
    return f"(SELECT run, z, y, j AS x, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM {y} u JOIN {turn} w ON u.x = w.i GROUP BY ALL)"


ORACLE_SQL = {
    "watershed_basins": _recursive("SELECT run, n // 64 AS z, n // 8 % 8 AS y, n % 8 AS x, top FROM t"),
    "watershed_picks": _recursive("SELECT run, round(avg(n % 8) * 10, 6) AS x, round(avg(n // 8 % 8) * 10, 6) AS y, round(avg(n // 64) * 10, 6) AS z, count(*) AS voxels FROM t GROUP BY run, top"),
    "response_mask": with_views(f"SELECT run, z, y, x, (v < 0)::INT AS label FROM {_along(_along('voxels', LINE), LINE)}", "voxels"),
    "resize_whole": with_views(f"SELECT run, z, y, x, round(v, 6) + 0.0::DOUBLE AS v FROM {_along('voxels', RESIZE)}", "voxels"),
    "log_spectrum": with_views(f"SELECT run, (z + 4) % 8 AS z, (y + 4) % 8 AS y, (x + 4) % 8 AS x, round(ln(sqrt(re * re + im * im) + 1), 5) AS v FROM {spectrum_sql(8)}", "voxels"),
    "mixup_beta": with_views(
        FLAT + f", {PAIRS}, l AS (SELECT sample_id, partner_id, list_sort([{', '.join(uniform_sql(f'beta-{k}', 'sample_id') for k in range(3))}])[2] AS lam FROM p) "
        "SELECT l.sample_id, a.i, round(lam * a.v + (1 - lam) * b.v, 6) AS v FROM l JOIN f a ON a.sample_id = l.sample_id JOIN f b ON b.sample_id = partner_id AND b.i = a.i",
        "samples",
    ),
    "mixup_beta_fractional": with_views(
        FLAT + f", {PAIRS}, q AS (SELECT sample_id, unnest(['g', 'h']) AS s, unnest(range(0, 2)) AS own FROM p), {GAMMA}, l AS (SELECT p.sample_id, partner_id, g / (g + h) AS lam FROM p JOIN gb USING (sample_id)) "
        "SELECT l.sample_id, a.i, round(lam * a.v + (1 - lam) * b.v, 6) AS v FROM l JOIN f a ON a.sample_id = l.sample_id JOIN f b ON b.sample_id = partner_id AND b.i = a.i",
        "samples",
    ),
    "dataset_roundtrip": "WITH v AS (SELECT p_partkey AS run, p_size + 8 AS d, p_partkey % 30 + 20 AS h FROM part), b AS (SELECT run, min(run) OVER (PARTITION BY d, h) AS bound FROM v) "
    "SELECT l_orderkey AS sample_id, bound AS run, l_returnflag AS key, 10.0::DOUBLE AS spacing FROM lineitem JOIN b ON b.run = l_partkey",
    "sets_replaced": with_views(
        "+ r AS (SELECT DISTINCT run, object_name FROM picks WHERE x < 40) "
        "SELECT object_name, user_id, count(*) AS n, round(sum(x), 3) AS x FROM (SELECT object_name, 'a' AS user_id, x FROM picks UNION ALL SELECT object_name, 'c', x FROM picks "
        "UNION ALL SELECT object_name, 'b', x FROM picks WHERE x < 40 OR (run, object_name) NOT IN (SELECT (run, object_name) FROM r)) GROUP BY 1, 2",
        "picks",
    ),
    "mesh_written": f"SELECT run, CASE WHEN f.run IS NOT NULL THEN 40 END AS vertices, 76 AS faces FROM (SELECT DISTINCT l_suppkey AS run FROM lineitem) LEFT JOIN {_plane(TOP)} f USING (run)",
    "segmentation_by_name": "WITH s AS (SELECT p_brand AS name, p_partkey AS run, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_brand, p_partkey, p_size + 7.5::DOUBLE FROM part), n AS (SELECT name, run, arg_min(v, (abs(v - 12), v)) AS v FROM s GROUP BY 1, 2) "
    "SELECT name, max(run) AS run, arg_max(v, run) AS voxel_spacing FROM n GROUP BY 1",
    "target_labels": "WITH k AS (SELECT DISTINCT p_brand AS config, p_type AS name FROM part) SELECT config, 'background' AS name, 0 AS label FROM (SELECT DISTINCT config FROM k) UNION ALL SELECT config, name, (row_number() OVER (PARTITION BY config ORDER BY name))::INT FROM k",
    "spacing_nm": "SELECT p_partkey AS ord, p_size / 10.0::DOUBLE AS nm FROM part",
    "array_fallback": "SELECT p_partkey AS run, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE 0.0 END AS first FROM part",
    "positive_frequencies": "SELECT p_partkey, k, round(k / (p_size * 10.0::DOUBLE), 9) AS f FROM (SELECT p_partkey, p_size, unnest(range(0, (p_size + 1) // 2)) AS k FROM part)",
    "downsample_volumes": with_views(f"SELECT run, z, y, x, round(v, 6) + 0.0::DOUBLE AS v FROM {fourier_sql(8, 4)} WHERE run IN (SELECT s_suppkey FROM supplier)", "voxels"),
    "downsample_jobs": with_views(
        "SELECT s_suppkey AS run, 'wbp-' || s_suppkey AS name, CASE WHEN r.run IS NOT NULL THEN 4 END AS d, CASE WHEN r.run IS NOT NULL THEN 4 END AS h, CASE WHEN r.run IS NOT NULL THEN 4 END AS w, CASE WHEN r.run IS NOT NULL THEN 64 END AS voxels, "
        "CASE WHEN r.run IS NULL THEN 'no volume' END AS error FROM supplier LEFT JOIN (SELECT DISTINCT run FROM voxels) r ON r.run = s_suppkey",
        "voxels",
    ),
    "slab_parallel": f"SELECT run, layer, r AS \"row\", k AS col, round(a * k * 50.0::DOUBLE / 3 + b * r * 63.0::DOUBLE / 2 + mz - a * mx - b * my, 3) AS z FROM {MEANS} m JOIN {_plane(CENTRED)} f USING (run), range(0, 3) t(r), range(0, 4) u(k)",
    "slab_pick_counts": "SELECT l_suppkey AS run, count(*) AS n, CASE WHEN count(*) < 3 THEN 'fewer than three points' END AS error FROM lineitem GROUP BY 1",
    "sphere_volume": "WITH s AS (SELECT s_suppkey AS run, " + ", ".join(f"floor({uniform_sql(f'sphere-{a}', 's_suppkey', 'id')} * 16)::INT AS c{a}" for a in "zyx") + f", floor({uniform_sql('sphere-r', 's_suppkey', 'id')} * 5)::INT + 3 AS r, {uniform_sql('sphere-v', 's_suppkey', 'id')} * 0.5::DOUBLE + 0.5::DOUBLE AS v FROM supplier, range(12) t(id)), "
    "f AS (SELECT run, z, y, x, round(coalesce(sum(v) FILTER ((z - cz) * (z - cz) + (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r), 0), 6) AS v FROM s, range(16) a(z), range(16) b(y), range(16) c(x) GROUP BY 1, 2, 3, 4) "
    "SELECT run, z, y, x, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM f WINDOW w AS (PARTITION BY run)",
}
