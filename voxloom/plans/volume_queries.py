"""Queries over dense volumes, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.rng import shuffle_sql, uniform_sql
from voxloom.operators import chunks as c
from voxloom.operators import sliding
from voxloom.operators import volume as v
from voxloom.sources import model
from voxloom.sources.model import EXTENT, SIDE, with_views

GATES = {"brightness": 0.3, "blur": 0.2, "intensity": 0.2, "flip": 0.2, "rotate": 0.2, "fourier": 0.3}
TTA = [round(((i * 7) % 11) / 10, 1) for i in range(64)]
SIGMA = 1.0


def _cube(f, *a, **k):
    return lambda spark, d: v.flat(f(model.samples(spark, d), *a, **k))


def _voxels(f, *a, **k):
    return lambda spark, d: f(model.voxels(spark, d), *a, **k)


def _mixup(spark, d):
    s = model.samples(spark, d)
    return v.flat(v.mixup(s, v.mixup_partners(s)))


def _batch(spark, d):
    s = model.samples(spark, d)
    return v.flat(v.mixup(s, v.batch_partners(s, 16, 0.7)))


def _loss(spark, d):
    s = model.classes(spark, d)
    ids = s.select("sample_id", F.col("molecule_id").alias("a"))
    other = ids.select(F.col("sample_id").alias("partner_id"), F.col("a").alias("b"))
    return v.mixup_loss(v.mixup_partners(s).join(ids, "sample_id").join(other, "partner_id").withColumn("pred", (F.col("sample_id") % 10).cast("int")))


def _chunks(f, *a):
    return lambda spark, d: c.flat(f(model.chunks(spark, d), "run", SIDE, *a), "run", SIDE, 6)


def _rows(samples):
    """Voxel rows of samples."""
    return samples.select("sample_id", F.posexplode("v").alias("i", "v")).select("sample_id", *model.coordinates("i", SIDE), "v")


def _blur(spark, d):
    return _rows(v.blur(model.samples(spark, d), SIDE, SIGMA)).withColumn("v", F.round("v", 6))


def _splice(hard):
    def run(spark, d):
        s = model.samples(spark, d).select("sample_id", "v")
        mask = s.withColumn("v", F.transform("v", lambda x: (x > 0.1).cast("double")))
        soft = mask if hard else v.blur(mask, SIDE, SIGMA)
        return _rows(v.splice(s, soft, s.withColumn("v", F.transform("v", lambda x: -x)), "sample_id"))

    return run


def _dilate(spark, d):
    seeds = model.chunks(spark, d).withColumn("v", F.transform("v", lambda x: (x > 0.25).cast("double")))
    return c.flat(v.dilate(seeds, "run", SIDE), "run", SIDE).where("v > 0").drop("v")


def _mask(**k):
    return lambda spark, d: v.masked(model.voxels(spark, d), "run", dict.fromkeys("zyx", EXTENT), **k)


def _profiles(spark, d):
    """Every catalogue entry asks for cutoffs of its own, in angstrom; 0 for none."""
    k, apix = F.col("ord"), F.col("radius") / 4.0
    low, high = (k % 5) * 10.5, (k % 3) * 20.5
    pixels = lambda cut: F.when(cut > 0, 16 * apix / cut).otherwise(0.0)
    jobs = model.catalogue(spark, d).select("ord", pixels(low).alias("low_pass"), F.lit(2.0).alias("low_decay"), pixels(high).alias("high_pass"), (k % 2).cast("double").alias("high_decay"))
    return v.filter_profiles(jobs, "ord", 16)


def _bandpass(spark, d):
    """A periodic convolution with fixed taps, the form that a band-pass takes on a small cube."""
    n = SIDE**3
    taps = F.explode(F.array(*[F.struct(F.lit(i).alias("tap"), F.lit(((i * 37) % 64) / 64.0).alias("h")) for i in range(n)]))
    flat = model.samples(spark, d).select("sample_id", F.posexplode("v").alias("q", "v")).select("*", taps.alias("t"))
    place = sum((((F.floor(F.col("q") / (16 // 4**k)) % 4 + F.floor(F.col("t.tap") / (16 // 4**k)) % 4) % 4) * (16 // 4**k) for k in range(3)), F.lit(0))
    return flat.select("sample_id", place.cast("int").alias("i"), (F.col("t.h") * F.col("v")).alias("v")).groupBy("sample_id", "i").agg(F.round(F.sum("v"), 5).alias("v"))


def _overlap(spark, d):
    flat = model.samples(spark, d).select((F.floor(F.col("sample_id") / 4)).alias("run"), (F.col("sample_id") % 4).alias("t"), F.posexplode("v").alias("i", "v"))
    weight = F.exp(-F.pow((F.col("i") - 31.5) / 16.0, F.lit(2)))
    return v.overlap_add(flat.select("run", (F.col("t") * 32 + F.col("i")).alias("at"), weight.alias("w"), "v"), "run")


def _ensemble(spark, d):
    flat = model.samples(spark, d).select("sample_id", F.posexplode("v").alias("i", "v"))
    return v.ensemble_argmax(flat.select("sample_id", (F.col("i") % 4).alias("cls"), F.col("v").alias("logit")), "sample_id")


QUERIES = {
    "zscore_eps": _cube(v.zscore),
    "zscore_guarded": _cube(v.zscore, True),
    "zscore_global": lambda spark, d: c.flat(sliding.normalised(model.chunks(spark, d), "run", SIDE), "run", SIDE, 6),
    "brightness": _cube(v.brightness),
    "intensity": _cube(v.intensity),
    **{f"flip_{a}": _cube(v.flip, a, SIDE) for a in "zyx"},
    **{f"rot90_{k}": _cube(v.rot90, k, ("y", "x"), SIDE) for k in (1, 2, 3)},
    "rot90_zx": _cube(v.rot90, 1, ("z", "x"), SIDE),
    "aug_gate_counts": lambda spark, d: v.gates(model.classes(spark, d), GATES),
    "mixup_pairs": _mixup,
    "batch_mixup": _batch,
    "mixup_loss": _loss,
    "blur_separable": _blur,
    "splice_blend": _splice(False),
    "splice_hard": _splice(True),
    "projections_sum": _voxels(v.projections, "run", "sum"),
    "projections_max": _voxels(v.projections, "run", "max"),
    "central_slices": _voxels(v.central_slices, "run", EXTENT),
    "minmax": lambda spark, d: v.range_of(model.samples(spark, d)),
    "threshold": lambda spark, d: model.voxels(spark, d).select("run", "z", "y", "x", (F.col("v") > 0.1).cast("int").alias("label")),
    "dilate2": _dilate,
    "neighbour_sum": _chunks(v.neighbour_sum),
    "local_maxima": _chunks(v.local_maxima),
    "cosine_mask_lp": _mask(low_pass=5.0, low_decay=2.0),
    "cosine_mask_hp": _mask(high_pass=3.0, high_decay=2.0),
    "cosine_mask_bp": _mask(low_pass=6.0, low_decay=2.0, high_pass=2.0, high_decay=1.0),
    "filter_profile": _profiles,
    "bandpass_apply_4cube": _bandpass,
    "tta_average": lambda spark, d: v.flat(v.tta_average(model.samples(spark, d), SIDE, TTA)),
    "overlap_add": _overlap,
    "fold_ensemble_argmax": _ensemble,
}

FLAT = "+ f AS (SELECT sample_id, unnest(v) AS v, unnest(range(0, 64)) AS i FROM samples) "


def _flat(sql: str) -> str:
    return with_views(FLAT + sql, "samples")


def _moved(z: str, y: str, x: str) -> str:
    return _flat(f"SELECT a.sample_id, a.i, round(b.v, 6) AS v FROM (SELECT sample_id, i, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x FROM f) a JOIN f b ON a.sample_id = b.sample_id AND b.i = ({z}) * 16 + ({y}) * 4 + ({x})")


PAIRS = (
    "n AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM samples), c AS (SELECT count(*) AS c FROM n), "
    f"p AS (SELECT a.sample_id, b.sample_id AS partner_id, {uniform_sql('mixup-lambda', 'a.sample_id')} AS lam FROM n a, c JOIN n b ON b.idx = (a.idx + 1 + floor({uniform_sql('mixup', 'a.sample_id')} * (c - 1))::INT) % c)"
)
KERNEL = "(VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in v.kernel(SIDE, SIGMA)) + ") k(t, s, w)"


def _blurred(source: str) -> str:
    z = f"(SELECT sample_id, t AS z, y, x, sum(v * w) AS v FROM {source} JOIN {KERNEL} ON z = s GROUP BY ALL)"
    y = f"(SELECT sample_id, z, t AS y, x, sum(v * w) AS v FROM {z} JOIN {KERNEL} ON y = s GROUP BY ALL)"
    return f"(SELECT sample_id, z, y, t AS x, sum(v * w) AS v FROM {y} JOIN {KERNEL} ON x = s GROUP BY ALL)"


MASK = "(SELECT sample_id, z, y, x, (v > 0.1)::INT::DOUBLE AS v FROM sample_voxels)"
SPLICED = "SELECT a.sample_id, a.z, a.y, a.x, round(a.v * w + -a.v * (1 - w), 6) AS v FROM sample_voxels a JOIN (SELECT sample_id, z, y, x, least(greatest(v, 0), 1) AS w FROM {}) m ON a.sample_id = m.sample_id AND a.z = m.z AND a.y = m.y AND a.x = m.x"


def _axes(how: str) -> str:
    parts = [f"SELECT run, {a} AS a, {b} AS b, round({how}(v), 6) AS v, '{c}' AS axis FROM voxels GROUP BY ALL" for c, a, b in (("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y"))]
    return with_views(" UNION ALL ".join(parts), "voxels")


AROUND = "(SELECT run, z - a AS z, y - b AS y, x - c AS x, v, a = 0 AND b = 0 AND c = 0 AS own FROM voxels, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) w(c) WHERE z - a BETWEEN 0 AND 7 AND y - b BETWEEN 0 AND 7 AND x - c BETWEEN 0 AND 7)"
STEP = "(SELECT DISTINCT run, z + a AS z, y + b AS y, x + c AS x FROM {} q, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(a, b, c) WHERE z + a BETWEEN 0 AND 7 AND y + b BETWEEN 0 AND 7 AND x + c BETWEEN 0 AND 7)"


def _edge(f: float, d: float) -> str:
    return f"(CASE WHEN r <= {f - d / 2} THEN 1.0::DOUBLE WHEN r >= {f + d / 2} THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * (r - {f - d / 2}) / {d}) END)"


def _under(weight: str) -> str:
    """Voxels under a mask around the place 4 of each axis."""
    return with_views(f"+ r AS (SELECT *, sqrt(((z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4))::DOUBLE) AS r FROM voxels) SELECT run, z, y, x, round({weight}, 6) AS w, round({weight} * v, 6) AS v FROM r", "voxels")


ORACLE_SQL = {
    "zscore_eps": _flat("SELECT sample_id, i, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 6) AS v FROM f WINDOW w AS (PARTITION BY sample_id)"),
    "zscore_guarded": _flat("SELECT sample_id, i, round(CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE v END, 6) AS v FROM f WINDOW w AS (PARTITION BY sample_id)"),
    "zscore_global": with_views("SELECT run, z, y, x, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) AS v FROM voxels WINDOW w AS (PARTITION BY run)", "voxels"),
    "brightness": _flat(f"SELECT sample_id, i, round(v + ({uniform_sql('brightness', 'sample_id')} - 0.5::DOUBLE), 6) AS v FROM f"),
    "intensity": _flat(f"SELECT sample_id, i, round(v * ({uniform_sql('intensity', 'sample_id')} + 0.5::DOUBLE), 6) AS v FROM f"),
    "flip_z": _moved("3 - z", "y", "x"),
    "flip_y": _moved("z", "3 - y", "x"),
    "flip_x": _moved("z", "y", "3 - x"),
    "rot90_1": _moved("z", "x", "3 - y"),
    "rot90_2": _moved("z", "3 - y", "3 - x"),
    "rot90_3": _moved("z", "3 - x", "y"),
    "rot90_zx": _moved("x", "y", "3 - z"),
    "aug_gate_counts": with_views("SELECT name, count(*) AS n FROM samples, (VALUES " + ", ".join(f"('{n}', {p}::DOUBLE)" for n, p in GATES.items()) + f") g(name, p) WHERE {uniform_sql('gate', 'name', 'sample_id')} < p GROUP BY 1", "samples"),
    "mixup_pairs": with_views(FLAT + f", {PAIRS} SELECT p.sample_id, a.i, round(lam * a.v + (1 - lam) * b.v, 6) AS v FROM p JOIN f a ON a.sample_id = p.sample_id JOIN f b ON b.sample_id = partner_id AND b.i = a.i", "samples"),
    "batch_mixup": with_views(
        FLAT + f", r AS (SELECT sample_id, sample_id // 16 AS batch, row_number() OVER (PARTITION BY sample_id // 16 ORDER BY sample_id) AS own, row_number() OVER (PARTITION BY sample_id // 16 ORDER BY {shuffle_sql('batch', 'sample_id')}, sample_id) AS drawn FROM samples) "
        "SELECT a.sample_id, x.i, round(0.7::DOUBLE * x.v + (1 - 0.7::DOUBLE) * y.v, 6) AS v FROM r a JOIN r b ON a.batch = b.batch AND a.own = b.drawn JOIN f x ON x.sample_id = a.sample_id JOIN f y ON y.sample_id = b.sample_id AND x.i = y.i",
        "samples",
    ),
    "mixup_loss": with_views(
        f"+ {PAIRS}, t AS (SELECT lam, a.molecule_id AS a, b.molecule_id AS b, p.sample_id % 10 AS pred FROM p JOIN samples a ON a.sample_id = p.sample_id JOIN samples b ON b.sample_id = partner_id) "
        "SELECT round(avg(lam * (pred - a) ** 2 + (1 - lam) * (pred - b) ** 2), 6) AS loss, round(avg(lam * (pred = a)::INT + (1 - lam) * (pred = b)::INT), 6) AS accuracy FROM t",
        "samples",
    ),
    "blur_separable": with_views(f"SELECT sample_id, z, y, x, round(v, 6) AS v FROM {_blurred('sample_voxels')}", "sample_voxels"),
    "splice_blend": with_views(SPLICED.format(_blurred(MASK)), "sample_voxels"),
    "splice_hard": with_views(SPLICED.format(MASK), "sample_voxels"),
    "projections_sum": _axes("sum"),
    "projections_max": _axes("max"),
    "central_slices": with_views(" UNION ALL ".join(f"SELECT run, '{a}' AS axis, z, y, x, round(v, 6) AS v FROM voxels WHERE {a} = 4" for a in "zyx"), "voxels"),
    "minmax": _flat("SELECT sample_id, round(min(v), 6) AS low, round(max(v), 6) AS high FROM f GROUP BY 1"),
    "threshold": with_views("SELECT run, z, y, x, (v > 0.1)::INT AS label FROM voxels", "voxels"),
    "dilate2": with_views(f"SELECT * FROM {STEP.format(STEP.format('(SELECT run, z, y, x FROM voxels WHERE v > 0.25)'))}", "voxels"),
    "neighbour_sum": with_views(f"SELECT run, z, y, x, round(sum(v), 6) AS v FROM {AROUND} GROUP BY ALL", "voxels"),
    "local_maxima": with_views(f"SELECT run, z, y, x, round(v, 6) AS v FROM (SELECT run, z, y, x, max(v) AS top, max(v) FILTER (own) AS v FROM {AROUND} GROUP BY 1, 2, 3, 4) WHERE v = top", "voxels"),
    "cosine_mask_lp": _under(_edge(5.0, 2.0)),
    "cosine_mask_hp": _under(f"(1 - {_edge(3.0, 2.0)})"),
    "cosine_mask_bp": _under(f"{_edge(6.0, 2.0)} * (1 - {_edge(2.0, 1.0)})"),
    "filter_profile": with_views(
        "+ j AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN 0 ELSE 16 * (radius / 4) / (ord % 5 * 10.5::DOUBLE) END AS lp, CASE WHEN ord % 3 = 0 THEN 0 ELSE 16 * (radius / 4) / (ord % 3 * 20.5::DOUBLE) END AS hp, ord % 2 AS hd FROM catalogue), "
        "e AS (SELECT ord, x, lp, hp, hd, abs(x - 8)::DOUBLE AS r, 0.5 + 0.5 * cos(pi() * (abs(x - 8) - (lp - 1)) / 2) AS ls, 0.5 + 0.5 * cos(pi() * (abs(x - 8) - (hp - 0.5))) AS hs FROM j, range(16) t(x)) "
        "SELECT ord, x::INT AS x, round(CASE WHEN lp = 0 OR r <= lp - 1 THEN 1 WHEN r >= lp + 1 THEN 0 ELSE ls END * CASE WHEN hp = 0 THEN 1 WHEN hd = 0 THEN (r >= hp)::INT WHEN r <= hp - 0.5 THEN 0 WHEN r >= hp + 0.5 THEN 1 ELSE 1 - hs END, 6) AS w FROM e",
        "catalogue",
    ),
    "bandpass_apply_4cube": _flat(
        "SELECT sample_id, ((i // 16 + t // 16) % 4) * 16 + ((i // 4 % 4 + t // 4 % 4) % 4) * 4 + (i % 4 + t % 4) % 4 AS i, round(sum(((t * 37) % 64) / 64.0::DOUBLE * v), 5) AS v FROM f, range(0, 64) h(t) GROUP BY ALL"
    ),
    "tta_average": _flat(
        "SELECT sample_id, i, round(v * t / 8, 6) AS v FROM f JOIN (SELECT z * 16 + y * 4 + x AS i, sum((((CASE WHEN m & 1 = 1 THEN 3 - z ELSE z END) * 16 + (CASE WHEN m & 2 = 2 THEN 3 - y ELSE y END) * 4 + (CASE WHEN m & 4 = 4 THEN 3 - x ELSE x END)) * 7 % 11) / 10.0::DOUBLE) AS t "
        "FROM range(0, 4) a(z), range(0, 4) b(y), range(0, 4) c(x), range(0, 8) d(m) GROUP BY 1) USING (i)"
    ),
    "overlap_add": _flat("SELECT run, at_ AS \"at\", round(sum(w * v) / sum(w), 6) AS v FROM (SELECT sample_id // 4 AS run, sample_id % 4 * 32 + i AS at_, exp(-(((i - 31.5::DOUBLE) / 16.0::DOUBLE) ** 2)) AS w, v FROM f) GROUP BY ALL"),
    "fold_ensemble_argmax": _flat("SELECT sample_id, cls FROM (SELECT sample_id, i % 4 AS cls, row_number() OVER (PARTITION BY sample_id ORDER BY round(avg(v), 9) DESC, i % 4) AS k FROM f GROUP BY sample_id, i % 4) WHERE k = 1"),
}
