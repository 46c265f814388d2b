"""Queries over points, boxes and surfaces, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import rng
from voxloom.functions.rng import uniform_sql
from voxloom.operators import geometry as g
from voxloom.operators import spatial as s
from voxloom.sources import model
from voxloom.sources.model import EXTENT, SIDE, SPACING, with_views

BOX, DISTANCE = 4, 2.0
#: Picks of one run where background is sought.
PICKS_A_RUN = 12


def _points(spark, d):
    return s.to_voxels(model.picks(spark, d), SPACING)


def _spread(spark, d):
    """All picks, in runs of a few each: however many picks there are, volumes keep room for background."""
    return _points(spark, d).withColumn("run", F.floor(F.col("point_id") / PICKS_A_RUN))


def _background(whole):
    return lambda spark, d: s.background(_spread(spark, d), EXTENT, BOX, DISTANCE, 1.5, whole=whole).withColumns({a: F.round(a, 6) for a in "xyz"})


def _with_background(spark, d):
    points = s.background(_spread(spark, d), EXTENT, BOX, DISTANCE, 1.5)
    return s.with_background(_spread(spark, d), points).groupBy("key", "is_background").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") + F.col("y") + F.col("z")), 3).alias("total"))


def _extract(strategy="centered", centred_pad=False):
    def run(spark, d):
        placed = s.boxes(_points(spark, d), BOX, EXTENT, s.strategy_shift(strategy, 8 if strategy == "random" else BOX), centred_pad)
        cut = s.digest(s.pieces(placed, model.chunks(spark, d), SIDE), BOX)
        return cut.unionByName(placed.where("status = 'invalid'").select("point_id", "status", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("weighted")))

    return run


def _grid(spark, d):
    points = s.grid_patches(model.chunks(spark, d), EXTENT, BOX, 0.25)
    return s.digest(s.pieces(s.boxes(points, BOX, EXTENT), model.chunks(spark, d), SIDE), BOX)


def _mask(spark, d):
    return model.voxels(spark, d).where("v > 0.1").select("run", "z", "y", "x")


def _labelled(spark, d):
    component = (F.floor(F.col("z") / 3) * 2 + F.floor(F.col("x") / 5)).cast("int")
    return _mask(spark, d).withColumn("component", component)


def _layers(spark, d):
    line = model.table(spark, d, "lineitem")
    z = F.when(F.col("l_linestatus") == "F", 300.0).otherwise(100.0) + F.col("l_quantity") * 0.5 - (F.col("l_partkey") % 64) * 0.25 + F.col("l_orderkey") % 5
    return line.select(F.col("l_suppkey").alias("run"), F.when(F.col("l_linestatus") == "F", "top").otherwise("bottom").alias("layer"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 64).cast("double").alias("y"), z.alias("z"))


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _fitted(spark, d):
    points = _layers(spark, d)
    fit = g.plane_fit(points, "run", "layer")
    return g.residuals(points.join(fit, ["run", "layer"]).withColumn("pred", F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")), "run", "layer")


def _knots(spark, d):
    flat = model.sample_voxels(spark, d)
    return g.bending_energy(flat.select("sample_id", "z", F.col("y").alias("row"), F.col("x").alias("col"), "v"), "sample_id", "z")


def _iou(spark, d):
    vox = model.voxels(spark, d)
    soft = lambda at: 1.0 / (1.0 + F.exp(-(F.col("v") - at) * 10.0))
    return g.soft_iou(vox.select("run", soft(0.0).alias("p"), soft(0.1).alias("q")))


def _runs(spark, d):
    return _layers(spark, d).select("run").distinct()


def _mesh_counts(spark, d):
    return g.mesh(_runs(spark, d), 5, 4).groupBy("run", "part").agg(F.count(F.lit(1)).alias("faces"), F.sum(F.col("a") + 2 * F.col("b") + 3 * F.col("c")).alias("digest"))


QUERIES = {
    "picks_to_voxels": lambda spark, d: _rounded(_points(spark, d).select("point_id", *"xyz"), 6, *"xyz"),
    "picks_to_index": lambda spark, d: s.to_index(model.picks(spark, d), SPACING).select("point_id", *"xyz"),
    "background_points": _background(True),
    "background_points_continuous": _background(False),
    "samples_with_background": _with_background,
    "extract_centered": _extract(),
    "extract_offset_center_pad": _extract(centred_pad=True),
    "extract_random": _extract("random"),
    "extract_jittered": _extract("jittered"),
    "grid_patches": _grid,
    "region_extract": lambda spark, d: _rounded(s.region(model.voxels(spark, d), EXTENT, z=(-2, 3), y=(2, 6), x=(5, 20)), 6, "v"),
    "surface_points": lambda spark, d: g.surface_points(_mask(spark, d), SPACING),
    "surface_points_stride": lambda spark, d: g.surface_points(_mask(spark, d), SPACING, 3),
    "component_stats": lambda spark, d: g.component_stats(_labelled(spark, d)),
    "centroid_boxes": lambda spark, d: g.centroid_boxes(g.component_stats(_labelled(spark, d)), BOX, EXTENT),
    "soft_iou": _iou,
    "residual_rms": _fitted,
    "bending_energy": _knots,
    "plane_fit_lsq": lambda spark, d: _rounded(g.plane_fit(_layers(spark, d), "run", "layer"), 4, "a", "b", "c"),
    "parallel_planes": lambda spark, d: _rounded(g.parallel_planes(_layers(spark, d)), 4, "a", "b", "top", "bottom"),
    "plane_lattice": lambda spark, d: _rounded(g.lattice(g.plane_fit(_layers(spark, d).where("layer = 'top'")), 3, 4, 50.0, 63.0), 3, "x", "y", "z"),
    "slab_mesh_counts": _mesh_counts,
}

V = "(SELECT point_id, run, object_name, x / 10.0::DOUBLE AS x, y / 10.0::DOUBLE AS y, z / 10.0::DOUBLE AS z FROM picks)"
#: All picks, in the runs where background is sought.
SPREAD = f"(SELECT * REPLACE (point_id // {PICKS_A_RUN} AS run) FROM {V})"


def _free(whole: bool) -> str:
    place = {a: f"floor({uniform_sql(f'background-{a}', 'run', 'attempt')} * 5)::INT + 2" if whole else f"{uniform_sql(f'background-{a}', 'run', 'attempt')} * 4 + 2" for a in "xyz"}
    tried = f"(SELECT run, attempt, want, {', '.join(f'{p} AS {a}' for a, p in place.items())} FROM (SELECT run, want, unnest(range(0, want * 10)) AS attempt FROM (SELECT run, floor(count(*) * 1.5::DOUBLE)::INT AS want FROM {SPREAD} GROUP BY 1) WHERE want > 0))"
    near = f"SELECT 1 FROM {SPREAD} p WHERE p.run = c.run AND (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z) < 4"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY attempt) AS k FROM {tried} c WHERE NOT EXISTS ({near})) WHERE k <= want)"


def _boxes(shift: str | None = None, m: int = 0, centred: bool = False) -> str:
    c = {a: f"{a} + (floor({uniform_sql(f'patch-{shift}-{a}', 'point_id')} * {2 * m + 1}) - {m})" if shift else a for a in "xyz"}
    ends = ", ".join(f"greatest(0, trunc({v} - 2)::INT) AS {a}l, least(8, trunc({v} + 2)::INT) AS {a}h, trunc({v})::INT AS {a}c" for a, v in c.items())
    pad = ", ".join((f"floor((4 - ({a}h - {a}l)) / 2)::INT" if centred else f"greatest(0, 2 - {a}c)") + f" AS {a}p" for a in "xyz")
    status = "CASE WHEN xh <= xl OR yh <= yl OR zh <= zl THEN 'invalid' WHEN xh - xl = 4 AND yh - yl = 4 AND zh - zl = 4 THEN 'valid' ELSE 'padded' END AS status"
    place = "(((v.z - zl + zp) * 4 + v.y - yl + yp) * 4 + v.x - xl + xp + 1)"
    return with_views(
        f"+ b AS (SELECT *, {pad}, {status} FROM (SELECT point_id, run, {ends} FROM {V})) "
        f"SELECT point_id, status, count(*) AS n, round(sum(v.v), 4) + 0.0::DOUBLE AS total, round(sum(v.v * {place}), 3) + 0.0::DOUBLE AS weighted FROM b JOIN voxels v ON b.run = v.run AND v.x >= xl AND v.x < xh AND v.y >= yl AND v.y < yh AND v.z >= zl AND v.z < zh WHERE status <> 'invalid' GROUP BY 1, 2 "
        "UNION ALL SELECT point_id, status, 0, 0, 0 FROM b WHERE status = 'invalid'",
        "picks",
        "voxels",
    )


SET = "(SELECT run, z, y, x FROM voxels WHERE v > 0.1)"
STATS = f"(SELECT *, row_number() OVER (PARTITION BY run ORDER BY area DESC, component) = 1 AS largest FROM (SELECT run, z // 3 * 2 + x // 5 AS component, count(*) AS area, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM {SET} GROUP BY 1, 2))"
LAYERS = "(SELECT l_suppkey AS run, CASE WHEN l_linestatus = 'F' THEN 'top' ELSE 'bottom' END AS layer, l_quantity AS x, (l_partkey % 64)::DOUBLE AS y, CASE WHEN l_linestatus = 'F' THEN 300.0::DOUBLE ELSE 100.0 END + l_quantity * 0.5::DOUBLE - (l_partkey % 64) * 0.25::DOUBLE + l_orderkey % 5 AS z FROM lineitem)"


def _plane(points: str, key: str = "run") -> str:
    sums = f"(SELECT {key}, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {points} GROUP BY ALL)"
    slope = f"(SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM {sums} WHERE n >= 3 AND abs(xx * yy - xy * xy) > 1e-9)"
    return f"(SELECT {key}, a, b, mz - a * mx - b * my AS c FROM {slope})"


TOP = f"(SELECT * FROM {LAYERS} WHERE layer = 'top')"
MEANS = f"(SELECT run, layer, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {LAYERS} GROUP BY 1, 2)"
CENTRED = f"(SELECT p.run, x - mx AS x, y - my AS y, z - mz AS z FROM {LAYERS} p JOIN {MEANS} m ON p.run = m.run AND p.layer = m.layer WHERE p.run IN (SELECT run FROM {MEANS} WHERE n >= 3 GROUP BY 1 HAVING count(*) = 2))"

ORACLE_SQL = {
    "picks_to_voxels": with_views(f"SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM {V}", "picks"),
    "picks_to_index": with_views(f"SELECT point_id, trunc(x)::INT AS x, trunc(y)::INT AS y, trunc(z)::INT AS z FROM {V}", "picks"),
    "background_points": with_views(f"SELECT run, attempt, x, y, z FROM {_free(True)}", "picks"),
    "background_points_continuous": with_views(f"SELECT run, attempt, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM {_free(False)}", "picks"),
    "samples_with_background": with_views(
        f"SELECT key, is_background, count(*) AS n, round(sum(x + y + z), 3) AS total FROM (SELECT object_name AS key, false AS is_background, x, y, z FROM {SPREAD} UNION ALL SELECT 'background', true, x, y, z FROM {_free(True)}) GROUP BY 1, 2", "picks"
    ),
    "extract_centered": _boxes(),
    "extract_offset_center_pad": _boxes(centred=True),
    "extract_random": _boxes("random", 1),
    "extract_jittered": _boxes("jittered", 2),
    "grid_patches": with_views(
        "+ p AS (SELECT DISTINCT run, a.s AS z, b.s AS y, c.s AS x FROM voxels, (VALUES (0), (3)) a(s), (VALUES (0), (3)) b(s), (VALUES (0), (3)) c(s)) "
        "SELECT ((p.run * 8 + p.z + 2) * 8 + p.y + 2) * 8 + p.x + 2 AS point_id, 'valid' AS status, count(*) AS n, round(sum(v), 4) AS total, round(sum(v * (((v.z - p.z) * 4 + v.y - p.y) * 4 + v.x - p.x + 1)), 3) AS weighted "
        "FROM p JOIN voxels v ON p.run = v.run AND v.z BETWEEN p.z AND p.z + 3 AND v.y BETWEEN p.y AND p.y + 3 AND v.x BETWEEN p.x AND p.x + 3 GROUP BY 1, 2",
        "voxels",
    ),
    "region_extract": with_views("SELECT run, z, y, x, round(v, 6) AS v FROM voxels WHERE z < 3 AND y BETWEEN 2 AND 5 AND x >= 5", "voxels"),
    "surface_points": with_views(f"SELECT run, y, x, min(z) * 10.0::DOUBLE AS bottom, max(z) * 10.0::DOUBLE AS top FROM {SET} GROUP BY ALL", "voxels"),
    "surface_points_stride": with_views(f"SELECT run, y, x, min(z) * 10.0::DOUBLE AS bottom, max(z) * 10.0::DOUBLE AS top FROM {SET} WHERE y % 3 = 0 AND x % 3 = 0 GROUP BY ALL", "voxels"),
    "component_stats": with_views(f"SELECT * FROM {STATS}", "voxels"),
    "centroid_boxes": with_views(
        "SELECT run, component, " + ", ".join(f"least(greatest(0, trunc(c{a} - 2)::INT), 4) AS {a}_lo, least(greatest(0, trunc(c{a} - 2)::INT), 4) + 4 AS {a}_hi" for a in "zyx") + f" FROM {STATS}", "voxels"
    ),
    "soft_iou": with_views("SELECT run, round(sum(p * q) / (sum(p) + sum(q) - sum(p * q)), 6) AS iou FROM (SELECT run, 1 / (1 + exp(-v * 10)) AS p, 1 / (1 + exp(-(v - 0.1::DOUBLE) * 10)) AS q FROM voxels) GROUP BY 1", "voxels"),
    "residual_rms": f"SELECT run, layer, round(sqrt(sum(e * e)), 5) AS norm, round(sqrt(avg(e * e)), 5) AS rms FROM (SELECT run, layer, f.a * x + f.b * y + f.c - z AS e FROM {LAYERS} p JOIN {_plane(LAYERS, 'run, layer')} f USING (run, layer)) GROUP BY 1, 2",
    "bending_energy": with_views(
        "+ d AS (SELECT sample_id, z, lead(v, 2) OVER r - 2 * lead(v, 1) OVER r + v AS r, lead(v, 2) OVER c - 2 * lead(v, 1) OVER c + v AS c FROM sample_voxels WINDOW r AS (PARTITION BY sample_id, z, x ORDER BY y), c AS (PARTITION BY sample_id, z, y ORDER BY x)) "
        "SELECT sample_id, z, round(coalesce(avg(r * r), 0) + coalesce(avg(c * c), 0), 5) AS energy FROM d GROUP BY 1, 2",
        "sample_voxels",
    ),
    "plane_fit_lsq": f"SELECT run, layer, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM {_plane(LAYERS, 'run, layer')}",
    "parallel_planes": f"SELECT run, round(a, 4) AS a, round(b, 4) AS b, round(max(mz - a * mx - b * my) FILTER (layer = 'top'), 4) AS top, round(max(mz - a * mx - b * my) FILTER (layer = 'bottom'), 4) AS bottom FROM {MEANS} m JOIN {_plane(CENTRED)} f USING (run) GROUP BY run, a, b",
    "plane_lattice": f"SELECT run, r AS \"row\", k AS col, round(k * 50.0::DOUBLE / 3, 3) AS x, round(r * 63.0::DOUBLE / 2, 3) AS y, round(a * (k * 50.0::DOUBLE / 3) + b * (r * 63.0::DOUBLE / 2) + c, 3) AS z FROM {_plane(TOP)}, range(0, 3) t(r), range(0, 4) u(k)",
    "slab_mesh_counts": """
WITH cell AS (SELECT r * 4 + k AS p FROM range(0, 4) t(r), range(0, 3) u(k)), edge AS (
  SELECT r * 4 AS i, r * 4 + 4 AS j FROM range(0, 4) t(r) UNION ALL SELECT r * 4 + 7, r * 4 + 3 FROM range(0, 4) t(r)
  UNION ALL SELECT k + 1, k FROM range(0, 3) t(k) UNION ALL SELECT 16 + k, 17 + k FROM range(0, 3) t(k)
), face AS (
  SELECT 'top' AS part, p AS a, p + 1 AS b, p + 4 AS c FROM cell UNION ALL SELECT 'top', p + 1, p + 5, p + 4 FROM cell
  UNION ALL SELECT 'bottom', p + 20, p + 24, p + 21 FROM cell UNION ALL SELECT 'bottom', p + 21, p + 24, p + 25 FROM cell
  UNION ALL SELECT 'wall', i, j, i + 20 FROM edge UNION ALL SELECT 'wall', j, j + 20, i + 20 FROM edge
)
SELECT run, part, count(*) AS faces, sum(a + 2 * b + 3 * c)::BIGINT AS digest FROM (SELECT DISTINCT l_suppkey AS run FROM lineitem), face GROUP BY 1, 2
""",
}
