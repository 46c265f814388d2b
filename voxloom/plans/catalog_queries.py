"""Queries over catalogues, strings and job results, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import text as t
from voxloom.operators import catalog as c
from voxloom.operators import chunks, classes
from voxloom.sources import model
from voxloom.sources.model import with_views


def _tomograms(f, *a):
    return lambda spark, d: f(model.tomograms(spark, d), *a)


def _parts(spark, d):
    return model.table(spark, d, "part")


def _segmentations(spark, d):
    """A customer's run has a tomogram if there is a filled order, a segmentation if there is an urgent one; runs of customers
    in debt are held out."""
    order = model.table(spark, d, "orders").withColumnRenamed("o_custkey", "run")
    test = model.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("run"))
    return tuple(order.where(x).select("run").distinct() for x in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'")) + (test,)


def _wanted(spark, d):
    """Objects of the catalogue that are looked for in a run, once each."""
    line = model.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("ord")).distinct()
    return line.join(model.catalogue(spark, d), "ord").select("run", "ord", "object_name", "radius")


def _training(i):
    return lambda spark, d: c.pairs_for_training(*_segmentations(spark, d))[i]


def _manifest(spark, d):
    paired = c.pairs_for_training(*_segmentations(spark, d))[0].join(model.table(spark, d, "customer").select(F.col("c_custkey").alias("run"), "c_name"), "run")
    case = t.case_id(F.col("c_name"))
    folder = F.when(F.col("split") == "train", "imagesTr").otherwise("imagesTs")
    return paired.select(case.alias("case_id"), "split", F.concat(folder, F.lit("/"), case, F.lit("_0000.nii.gz")).alias("image"), F.when(F.col("split") == "train", F.concat(F.lit("labelsTr/"), case, F.lit(".nii.gz"))).alias("label"))


def _logs(spark, d):
    return model.table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("process"), "ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("priority"))


def _results(spark, d):
    order = model.table(spark, d, "orders")
    ok = F.col("o_orderstatus") != "F"
    return order.select(F.col("o_orderkey").alias("task_id"), ok.alias("success"), (F.col("o_orderkey") % 4).alias("worker"), F.col("o_totalprice").alias("seconds"), F.when(~ok, F.concat(F.lit("task "), F.col("o_orderkey").cast("string"), F.lit(" failed"))).alias("error"))


def _uris(spark, d):
    part = _parts(spark, d)
    k = F.col("p_partkey")
    uri = F.when(k % 3 == 0, F.concat("p_type", F.lit("@"), "p_size")).when(k % 3 == 1, F.concat("p_type", F.lit(":user"), (k % 5).cast("string"), F.lit("@"), "p_size")).otherwise(F.concat("p_type", F.lit(":user"), (k % 5).cast("string"), F.lit("/s"), (k % 4).cast("string"), F.lit("@"), "p_size"))
    return part.select("p_partkey", t.segmentation_uri(F.translate(uri, " ", "-")).alias("u")).select("p_partkey", "u.*")


def _cutoffs(spark, d):
    return _parts(spark, d).select("p_partkey", "p_name", (F.col("p_size") / 4.0).alias("apix"), ((F.col("p_partkey") % 5) * 10.5).alias("lp"), ((F.col("p_partkey") % 3) * 20.5).alias("hp"))


def _cache_metadata(spark, d):
    s = model.classes(spark, d)
    return s.agg(F.count(F.lit(1)).alias("total_samples"), F.count_distinct("molecule_id").alias("unique_molecules"), F.sum(F.col("is_background").cast("int")).alias("background_samples")).withColumn("boxsize", F.lit("4x4x4"))


def _rescale(spark, d):
    part = _parts(spark, d)
    n, spacing = F.col("p_partkey") % 200 + 20, F.lit(10.0)
    return part.select("p_partkey", t.rescaled(n, spacing, spacing + F.col("p_size") / 2.0).alias("size"))


QUERIES = {
    "picks_catalog_join": lambda spark, d: model.picks(spark, d).join(F.broadcast(model.objects(spark, d)), "object_name").where("from_tool").select("point_id", "object_name", "label"),
    "picks_unknown_objects": lambda spark, d: model.picks(spark, d).join(F.broadcast(model.objects(spark, d)), "object_name", "left_anti").groupBy("object_name").agg(F.count(F.lit(1)).alias("n")),
    "picks_is_particle": lambda spark, d: model.picks(spark, d).join(F.broadcast(model.objects(spark, d).where("is_particle")), "object_name", "left_semi").select("point_id", "object_name"),
    "runs_with_tomogram_and_picks": lambda spark, d: model.picks(spark, d).where("from_tool").join(model.chunks(spark, d).select("run").distinct(), "run").groupBy("run").agg(F.count(F.lit(1)).alias("n")),
    "run_selection": lambda spark, d: c.choose_runs(model.tomograms(spark, d), ["Brand#11", "Brand#23", "none"]).select("run", "ord"),
    "run_selection_fallback": _tomograms(c.run_or_all, "no such run"),
    "tomogram_preference": _tomograms(c.preferred, "STEEL"),
    "nearest_spacing": _tomograms(c.nearest_spacing, 20.4),
    "tomogram_at_spacing": _tomograms(c.at_spacing, 7.0),
    "pyramid_level": lambda spark, d: c.arrays_at_level(_wanted(spark, d), chunks.extents(model.chunks(spark, d), "run", model.SIDE)),
    "shape_probe": lambda spark, d: model.chunks(spark, d).groupBy("run").agg(*[((F.max(f"c{a}") + 1) * model.SIDE).alias(a) for a in "zyx"]),
    "class_id_names": lambda spark, d: model.classes(spark, d).join(F.broadcast(model.objects(spark, d).select(F.col("label").alias("molecule_id"), "object_name")), "molecule_id", "left").select("sample_id", F.when(F.col("molecule_id") == -1, "background").otherwise(F.coalesce("object_name", F.concat(F.lit("Unknown_Label_"), F.col("molecule_id").cast("string")))).alias("name")),
    "skip_membrane": lambda spark, d: c.without_named(model.catalogue(spark, d).select("ord", F.col("kind").alias("name")), "Promo"),
    "train_runs_anti": lambda spark, d: (lambda x: x[0].join(x[2], "run", "left_anti"))(_segmentations(spark, d)),
    "training_pairs": _training(0),
    "missing_pairs_report": _training(1),
    "export_manifest": _manifest,
    "config_latest": lambda spark, d: c.latest(_logs(spark, d), ["process"]).select("process", "log_id"),
    "delete_source_remaining": lambda spark, d: model.tomograms(spark, d).where("tomo_type <> 'PROMO'").groupBy("voxel_spacing").agg(F.count(F.lit(1)).alias("left")),
    "cache_key": lambda spark, d: _parts(spark, d).select("p_partkey", t.cache_key(F.col("p_name"), [F.lit(4), F.lit(4), F.lit(4)], F.col("p_size"), F.col("p_partkey") % 2 == 0, F.lit("parquet")).alias("key")),
    "cache_metadata": _cache_metadata,
    "output_name": lambda spark, d: _cutoffs(spark, d).select("p_partkey", t.output_name(F.col("p_name"), F.col("lp"), F.col("hp"), F.when(F.col("p_partkey") % 11 == 0, F.lit("given"))).alias("name")),
    "filter_validate": lambda spark, d: _cutoffs(spark, d).select("p_partkey", t.filter_problem(F.col("apix"), F.col("lp"), F.col("hp")).alias("problem")),
    "frequency_pixels": lambda spark, d: _cutoffs(spark, d).where("lp > 0").select("p_partkey", F.round(F.greatest(F.lit(32), F.lit(64), F.lit(48)) / (F.col("lp") / F.col("apix")), 6).alias("pixels")),
    "uri_parse": _uris,
    "list_parse": lambda spark, d: _parts(spark, d).select("p_partkey", F.posexplode(t.list_items(F.concat(F.lit("["), F.regexp_replace("p_name", " ", " , "), F.lit("]")))).alias("pos", "item")),
    "case_id": lambda spark, d: _parts(spark, d).select("p_partkey", t.case_id(F.col("p_name")).alias("case_id"), t.file_name(F.col("p_type")).alias("file_name")),
    "strip_scheme": lambda spark, d: model.table(spark, d, "pages").select("page_id", t.without_scheme(F.concat(F.lit("local://"), "url")).alias("path")),
    "rescale_shapes": _rescale,
    "job_summary": lambda spark, d: c.job_summary(_results(spark, d)),
    "worker_stats": lambda spark, d: c.worker_stats(_results(spark, d)),
    "pick_ids": lambda spark, d: model.picks(spark, d).groupBy("run", "object_name").agg(F.count(F.lit(1)).alias("n")).withColumn("first_id", F.coalesce(F.sum("n").over(W.orderBy("run", "object_name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))),
    "class_rollup": lambda spark, d: model.picks(spark, d).rollup("run", "object_name").agg(F.count(F.lit(1)).alias("n")),
    "balanced_by_document_label": lambda spark, d: classes.distribution(model.table(spark, d, "labels").select((F.col("quality") * 2 + F.col("toxic")).cast("int").alias("molecule_id"))),
}

PARTS = "(SELECT run, tomo_type, voxel_spacing, ord FROM tomograms)"
THERE = "(SELECT o_custkey AS run, bool_or(o_orderstatus = 'F') AS tomogram, bool_or(o_orderpriority = '1-URGENT') AS segmentation FROM orders GROUP BY 1)"
HELD = "(SELECT c_custkey AS run FROM customer WHERE c_acctbal < 0)"
RESULTS = "(SELECT o_orderkey AS task_id, o_orderstatus <> 'F' AS success, o_orderkey % 4 AS worker, o_totalprice AS seconds, 'task ' || o_orderkey || ' failed' AS error FROM orders)"
CUTOFFS = "(SELECT p_partkey, p_name, p_size / 4.0::DOUBLE AS apix, (p_partkey % 5) * 10.5::DOUBLE AS lp, (p_partkey % 3) * 20.5::DOUBLE AS hp FROM part)"
URI = "replace(CASE p_partkey % 3 WHEN 0 THEN p_type || '@' || p_size WHEN 1 THEN p_type || ':user' || p_partkey % 5 || '@' || p_size ELSE p_type || ':user' || p_partkey % 5 || '/s' || p_partkey % 4 || '@' || p_size END, ' ', '-')"
CASE_ID = "translate(c_name, '- ', '__')"
ORACLE_SQL = {
    "picks_catalog_join": with_views("SELECT point_id, object_name, label FROM picks JOIN objects USING (object_name) WHERE from_tool", "picks", "objects"),
    "picks_unknown_objects": with_views("SELECT object_name, count(*) AS n FROM picks WHERE object_name NOT IN (SELECT object_name FROM objects) GROUP BY 1", "picks", "objects"),
    "picks_is_particle": with_views("SELECT point_id, object_name FROM picks WHERE object_name IN (SELECT object_name FROM objects WHERE is_particle)", "picks", "objects"),
    "runs_with_tomogram_and_picks": with_views("SELECT run, count(*) AS n FROM picks WHERE from_tool AND run IN (SELECT vec_id // 8 FROM embeddings GROUP BY 1 HAVING count(*) = 8) GROUP BY 1", "picks"),
    "run_selection": with_views("SELECT run, ord FROM tomograms WHERE run IN ('Brand#11', 'Brand#23')", "tomograms"),
    "run_selection_fallback": with_views("SELECT * FROM tomograms", "tomograms"),
    "tomogram_preference": with_views(f"SELECT run, ord, tomo_type, voxel_spacing FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY contains(tomo_type, 'STEEL') DESC, ord) AS k FROM {PARTS}) WHERE k = 1", "tomograms"),
    "nearest_spacing": with_views(f"+ b AS (SELECT run, voxel_spacing FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(voxel_spacing - 20.4::DOUBLE), ord) AS k FROM {PARTS}) WHERE k = 1) SELECT t.* FROM tomograms t JOIN b ON t.run = b.run AND t.voxel_spacing = b.voxel_spacing", "tomograms"),
    "tomogram_at_spacing": with_views(f"SELECT run, ord, tomo_type FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) AS k FROM {PARTS} WHERE voxel_spacing = 7) WHERE k = 1", "tomograms"),
    "pyramid_level": with_views("+ w AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS ord FROM lineitem), e AS (SELECT vec_id // 8 AS run, 8 AS n FROM embeddings GROUP BY 1 HAVING count(*) = 8), l AS (SELECT *, (radius > 16)::INT AS level FROM w JOIN catalogue USING (ord)) "
    "SELECT run, ord, object_name, level, level + 1 AS scale, n // (level + 1) AS d, n // (level + 1) AS h, n // (level + 1) AS w FROM l LEFT JOIN e USING (run)", "catalogue"),
    "shape_probe": "SELECT vec_id // 8 AS run, 8 AS z, 8 AS y, 8 AS x FROM embeddings GROUP BY 1 HAVING count(*) = 8",
    "class_id_names": with_views("SELECT sample_id, CASE WHEN molecule_id = -1 THEN 'background' ELSE coalesce(object_name, 'Unknown_Label_' || molecule_id) END AS name FROM samples LEFT JOIN objects ON label = molecule_id", "samples", "objects"),
    "skip_membrane": "SELECT p_partkey AS ord, p_type AS name FROM part WHERE lower(p_type) <> 'promo'",
    "train_runs_anti": f"SELECT run FROM {THERE} WHERE tomogram EXCEPT FROM {HELD}",
    "training_pairs": f"SELECT run, CASE WHEN run IN (FROM {HELD}) THEN 'test' ELSE 'train' END AS split FROM {THERE} WHERE tomogram AND segmentation",
    "missing_pairs_report": f"SELECT run, CASE WHEN tomogram THEN 'segmentation' ELSE 'tomogram' END AS missing FROM {THERE} WHERE tomogram <> segmentation",
    "export_manifest": f"SELECT c AS case_id, split, CASE split WHEN 'train' THEN 'imagesTr' ELSE 'imagesTs' END || '/' || c || '_0000.nii.gz' AS image, CASE split WHEN 'train' THEN 'labelsTr/' || c || '.nii.gz' END AS label FROM (SELECT {CASE_ID} AS c, CASE WHEN c_acctbal < 0 THEN 'test' ELSE 'train' END AS split FROM customer JOIN {THERE} ON run = c_custkey WHERE tomogram AND segmentation)",
    "config_latest": "SELECT process, log_id FROM (SELECT user_id AS process, event_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "delete_source_remaining": with_views("SELECT voxel_spacing, count(*) AS \"left\" FROM tomograms WHERE tomo_type <> 'PROMO' GROUP BY 1", "tomograms"),
    "cache_key": "SELECT p_partkey, p_name || '_4x4x4_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_with_bg' ELSE '' END || '.parquet' AS key FROM part",
    "cache_metadata": "SELECT count(*) AS total_samples, count(DISTINCT label) AS unique_molecules, sum((label = 0)::INT)::BIGINT AS background_samples, '4x4x4' AS boxsize FROM embeddings",
    "output_name": f"SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'given' ELSE p_name || CASE WHEN lp > 0 THEN '-lp' || round_even(lp, 0)::BIGINT || 'A' ELSE '' END || CASE WHEN hp > 0 THEN '-hp' || round_even(hp, 0)::BIGINT || 'A' ELSE '' END END AS name FROM {CUTOFFS}",
    "filter_validate": f"SELECT p_partkey, CASE WHEN lp = 0 AND hp = 0 THEN 'no cutoff' WHEN lp > 0 AND lp < 2 * apix THEN 'low-pass beyond Nyquist' WHEN hp > 0 AND hp < 2 * apix THEN 'high-pass beyond Nyquist' WHEN lp > 0 AND hp > 0 AND hp <= lp THEN 'empty band' END AS problem FROM {CUTOFFS}",
    "frequency_pixels": f"SELECT p_partkey, round(64 / (lp / apix), 6) AS pixels FROM {CUTOFFS} WHERE lp > 0",
    "uri_parse": f"SELECT p_partkey, nullif(regexp_extract(u, '^([^:@]+)', 1), '') AS name, nullif(regexp_extract(u, '^[^:@]+:([^/@]+)', 1), '') AS user_id, nullif(regexp_extract(u, '^[^:@]+:[^/@]+/([^@]+)', 1), '') AS session_id, nullif(regexp_extract(u, '@(.+)$', 1), '')::DOUBLE AS voxel_spacing FROM (SELECT p_partkey, {URI} AS u FROM part)",
    "list_parse": "SELECT p_partkey, unnest(range(0, len(s))) AS pos, unnest(s) AS item FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)",
    "case_id": "SELECT p_partkey, translate(p_name, '- ', '__') AS case_id, translate(lower(p_type), '- ', '__') AS file_name FROM part",
    "strip_scheme": "SELECT page_id, url AS path FROM pages",
    "rescale_shapes": "SELECT p_partkey, s - s % 2 AS size FROM (SELECT p_partkey, round_even((p_partkey % 200 + 20) * 10.0::DOUBLE / (10.0::DOUBLE + p_size / 2.0::DOUBLE), 0)::INT AS s FROM part)",
    "job_summary": f"SELECT count(*) AS tasks, count(*) FILTER (success) AS done, round(sum(seconds) FILTER (success), 2) AS seconds, (SELECT string_agg(error, '; ' ORDER BY task_id) FROM (SELECT * FROM {RESULTS} WHERE NOT success ORDER BY task_id LIMIT 5)) AS errors, greatest(count(*) FILTER (NOT success) - 5, 0) AS more FROM {RESULTS}",
    "worker_stats": f"SELECT worker, count(*) AS tasks, round(sum(seconds), 2) AS total, round(avg(seconds), 4) AS mean, count(*) FILTER (NOT success) AS failed FROM {RESULTS} GROUP BY 1",
    "pick_ids": with_views("SELECT run, object_name, n, coalesce(sum(n) OVER (ORDER BY run, object_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id FROM (SELECT run, object_name, count(*) AS n FROM picks GROUP BY 1, 2)", "picks"),
    "class_rollup": with_views("SELECT run, object_name, count(*) AS n FROM picks GROUP BY ROLLUP (run, object_name)", "picks"),
    "balanced_by_document_label": "SELECT 'class_' || (quality * 2 + toxic) AS class_name, count(*) AS n FROM labels GROUP BY 1",
}
