"""Queries over classes, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.rng import shuffle_sql, uniform_sql
from voxloom.operators import classes as c
from voxloom.sources import model
from voxloom.sources.model import with_views


def _on(f, *a, **k):
    return lambda spark, d: f(model.classes(spark, d), *a, **k)


def _without_rare(spark, d):
    return model.classes(spark, d).where("molecule_id <> 3")


NAME = "CASE WHEN molecule_id = -1 THEN 'background' ELSE 'class_' || molecule_id END"
COUNTED = "+ c AS (SELECT molecule_id, count(*) AS n FROM samples GROUP BY 1) "

QUERIES = {
    "class_distribution": _on(c.distribution),
    "class_distribution_pct": _on(c.distribution_pct),
    "sample_weights": _on(c.weights),
    "balanced_sampler_weights": _on(c.sampler_weights),
    "balanced_draw_replacement": _on(c.draw, 200),
    "balanced_draw_no_replacement": _on(c.draw_once, 100),
    "max_samples_subset": _on(c.subset, 100),
    "stratified_split": _on(c.split),
    "undersample": _on(c.undersample, 0.8),
    "oversample": _on(c.oversample, 0.8),
    "first_example_per_class": _on(c.examples),
    "first_k_per_class": _on(c.examples, 3),
    "k_random_per_class": _on(c.examples, 4, "examples"),
    "worker_shards": lambda spark, d: c.shards(model.picks(spark, d), "run", 4),
    "key_set_diff": lambda spark, d: c.key_differences(model.classes(spark, d), _without_rare(spark, d)),
    "proportion_check": lambda spark, d: c.proportions_agree(model.classes(spark, d), _without_rare(spark, d)),
    "classes_with_background": lambda spark, d: model.classes(spark, d).select(c.class_name().alias("class_name")).distinct().orderBy("class_name"),
    "split_sizes": lambda spark, d: c.split(model.classes(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n")),
}

SHUFFLED = shuffle_sql("split", "sample_id")
ORACLE_SQL = {
    "class_distribution": with_views(f"SELECT {NAME} AS class_name, count(*) AS n FROM samples GROUP BY 1", "samples"),
    "class_distribution_pct": with_views(f"SELECT {NAME} AS class_name, count(*) AS n, round(100.0::DOUBLE * count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS pct FROM samples GROUP BY 1", "samples"),
    "sample_weights": with_views("SELECT sample_id, round((count(*) OVER ())::DOUBLE / count(*) OVER (PARTITION BY molecule_id), 6) AS weight FROM samples", "samples"),
    "balanced_sampler_weights": with_views(COUNTED + "SELECT sample_id, round(1.0::DOUBLE / ((SELECT count(*) FROM c) * n), 12) AS weight FROM samples JOIN c USING (molecule_id)", "samples"),
    "balanced_draw_replacement": with_views(
        COUNTED + ", k AS (SELECT *, row_number() OVER (ORDER BY molecule_id) - 1 AS k FROM c), r AS (SELECT sample_id, molecule_id, row_number() OVER (PARTITION BY molecule_id ORDER BY sample_id) - 1 AS r FROM samples), "
        f"d AS (SELECT draw, floor({uniform_sql('draw-class', 'draw')} * (SELECT count(*) FROM c))::INT AS k FROM range(200) t(draw)) "
        f"SELECT draw, sample_id FROM d JOIN k USING (k) JOIN r ON r.molecule_id = k.molecule_id AND r.r = floor({uniform_sql('draw-row', 'draw')} * n)::INT",
        "samples",
    ),
    "balanced_draw_no_replacement": with_views(COUNTED + f"SELECT sample_id FROM samples JOIN c USING (molecule_id) ORDER BY ln(greatest({uniform_sql('once', 'sample_id')}, 1e-12)) * n DESC, sample_id LIMIT 100", "samples"),
    "max_samples_subset": with_views(f"SELECT sample_id FROM samples ORDER BY {shuffle_sql('subset', 'sample_id')}, sample_id LIMIT 100", "samples"),
    "stratified_split": with_views(
        COUNTED + f", p AS (SELECT sample_id, molecule_id, n, row_number() OVER (PARTITION BY molecule_id ORDER BY {SHUFFLED}, sample_id) AS pos FROM samples JOIN c USING (molecule_id)) "
        "SELECT sample_id, molecule_id, CASE WHEN pos <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM p",
        "samples",
    ),
    "undersample": with_views(
        COUNTED + f", p AS (SELECT sample_id, molecule_id, n, row_number() OVER (PARTITION BY molecule_id ORDER BY {shuffle_sql('under', 'sample_id')}, sample_id) AS pos FROM samples JOIN c USING (molecule_id)) "
        "SELECT sample_id, molecule_id FROM p WHERE pos <= n - floor((n - (SELECT min(n) FROM c)) * 0.8::DOUBLE)",
        "samples",
    ),
    "oversample": with_views(
        COUNTED + ", m AS (SELECT molecule_id, n, unnest(range(1, 1 + floor(((SELECT max(n) FROM c) - n) * 0.8::DOUBLE)::INT)) AS copy FROM c), r AS (SELECT sample_id, molecule_id, row_number() OVER (PARTITION BY molecule_id ORDER BY sample_id) - 1 AS r FROM samples) "
        "SELECT sample_id, molecule_id, 0 AS copy FROM samples UNION ALL "
        f"SELECT sample_id, m.molecule_id, copy FROM m JOIN r ON r.molecule_id = m.molecule_id AND r.r = floor({uniform_sql('over', 'm.molecule_id', 'copy')} * n)::INT",
        "samples",
    ),
    "first_example_per_class": with_views("SELECT molecule_id, 1 AS rank, min(sample_id) AS sample_id FROM samples GROUP BY 1", "samples"),
    "first_k_per_class": with_views("SELECT * FROM (SELECT molecule_id, row_number() OVER (PARTITION BY molecule_id ORDER BY sample_id) AS rank, sample_id FROM samples) WHERE rank <= 3", "samples"),
    "k_random_per_class": with_views(f"SELECT * FROM (SELECT molecule_id, row_number() OVER (PARTITION BY molecule_id ORDER BY {shuffle_sql('examples', 'sample_id')}, sample_id) AS rank, sample_id FROM samples) WHERE rank <= 4", "samples"),
    "worker_shards": with_views("SELECT run, (row_number() OVER (ORDER BY run) - 1) % 4 AS worker FROM (SELECT DISTINCT run FROM picks)", "picks"),
    "key_set_diff": "SELECT 'class_3' AS class_name, 'first' AS side FROM embeddings WHERE label = 3 LIMIT 1",
    "proportion_check": with_views(
        f"+ s AS (SELECT {NAME} AS class_name, molecule_id FROM samples), p AS (SELECT class_name, count(*)::DOUBLE / (SELECT count(*) FROM s) AS p FROM s GROUP BY 1), "
        "q AS (SELECT class_name, count(*)::DOUBLE / (SELECT count(*) FROM s WHERE molecule_id <> 3) AS q FROM s WHERE molecule_id <> 3 GROUP BY 1) "
        "SELECT class_name, round(abs(coalesce(p, 0) - coalesce(q, 0)), 9) AS gap, abs(coalesce(p, 0) - coalesce(q, 0)) < 0.05 AS agrees FROM p FULL JOIN q USING (class_name)",
        "samples",
    ),
    "classes_with_background": with_views(f"SELECT DISTINCT {NAME} AS class_name FROM samples", "samples"),
    "split_sizes": with_views(
        COUNTED + "SELECT part, sum(k)::BIGINT AS n FROM (SELECT 'train' AS part, floor(n * 0.6::DOUBLE) AS k FROM c UNION ALL SELECT 'val', floor(n * 0.2::DOUBLE) FROM c UNION ALL SELECT 'test', n - floor(n * 0.6::DOUBLE) - floor(n * 0.2::DOUBLE) FROM c) GROUP BY 1",
        "samples",
    ),
}
