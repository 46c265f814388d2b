"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words; its documents, in the order of a hash of their ids, are taken until the
target is met, at most `repeats` times over. The source's weight schedule over training time, integrated and scaled to
its target, says how many of its words are due by any time; inverted, it gives each document the time at which its first
taken word is due, and documents are range-sorted by that time.

Cumulative words come from two levels of sums, over hash buckets and within a bucket, so a source with most of the rows
is spread over all tasks. Only ids, sources and sizes are shuffled. Sources are a dimension: one row each is sorted.

Null and empty texts have size 0 and take nothing; a null source is a source, the last one. Rows of equal ids count
each by itself. An empty table gives no rows. Equal input gives equal output, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import common

#: Weights dealt to the sources in turn, and each one's schedule: its weight at the start and at the end of training.
CYCLE = (5, 2, 1)
RAMPS = ((1.0, 3.0), (1.0, 1.0), (3.0, 1.0))
SHARE, REPEATS = 1.5, 2
#: Rows of a hash bucket, about, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1024, 65_536


def sizes(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and the place _h in the hash order; and the columns `also`."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(common.text_or_empty(), F.lit(common.WORD_PATTERN)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"),
        *also,
    )


def targets(totals: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """From (source, source_size): target, _quota in whole words, and the ends _from, _to of the weight schedule.

    A target above `repeats` times its source stops there and the excess is shared among the others by weight. With
    sources sorted by limit per weight, those that stop come first, so cumulative sums find the common level."""
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(CYCLE)
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("_turn") + 1)
    by_limit = W.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    everyone = W.partitionBy()
    level = (share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("_weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    return (
        totals.withColumn("_turn", turn)
        .withColumn("_weight", pick(CYCLE))
        .withColumn("_limit", repeats * F.col("source_size"))
        .withColumn("_level", level)
        .withColumn("_stops", F.col("_limit") / F.col("_weight") <= F.col("_level"))
        .withColumn("_common", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everyone))
        .withColumn("target", F.when(F.col("_stops"), F.col("_limit").cast("double")).otherwise(F.col("_common") * F.col("_weight")))
        .withColumn("_quota", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("_from", pick([a for a, _ in RAMPS]))
        .withColumn("_to", pick([b for _, b in RAMPS]))
        .select("source", "source_size", "target", "_quota", "_from", "_to")
    )


def due(done: Column, start: Column, end: Column) -> Column:
    """The time in 0..1 by which a share `done` of a source is due whose weight runs from start to end.

    The integral of the weight up to t is start*t + (end-start)*t*t/2; this is its inverse, in a form without
    cancellation that also holds for a constant weight."""
    goal = done * (start + end) / 2
    return 2 * goal / (start + F.sqrt(start * start + 2 * (end - start) * goal))


def mix(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and position, null if nothing is taken.

    Rows keep the columns `also`, which order those of equal id and size; with them comes positions, those of every time
    that the document is taken."""
    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    spark = docs.sparkSession
    sized = common.written(sizes(docs, also), "mixing")
    buckets = max(1, min(MOST_BUCKETS, sized.count() // BUCKET_ROWS))
    placed = sized.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0 * buckets).cast("int"))
    in_bucket = placed.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    in_bucket = in_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    goals = targets(in_bucket.groupBy("source").agg(F.sum("_n").alias("source_size")), share, repeats)
    in_bucket = in_bucket.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "source_size", "target", "_quota", "_from", "_to")
    within = W.partitionBy("source", "_b").orderBy("_h", "size", "doc_id", *also).rowsBetween(W.unboundedPreceding, -1)
    run = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = (
        run.alias("d")
        .join(in_bucket.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d._b") == F.col("b._b")))
        .select("d.doc_id", "d.source", "d.size", (F.col("_before") + F.col("_within")).alias("_start"), "source_size", "target", "_quota", "_from", "_to", *[f"d.{c}" for c in also])
    )
    part = lambda k: F.least(F.col("size"), F.greatest(F.lit(0), F.col("_quota") - F.col("_start") - k * F.col("source_size")))
    taken = sum((part(k) for k in range(1, repeats)), part(0))
    at = lambda k: F.round(due((F.col("_start") + k * F.col("source_size")) / F.col("_quota"), F.col("_from"), F.col("_to")), 9)
    mixed = joined.withColumn("taken", taken.cast("long")).withColumn("position", F.when(F.col("taken") > 0, at(0)))
    if also:
        mixed = mixed.withColumn("positions", F.array_compact(F.array(*[F.when(part(k) > 0, at(k)) for k in range(repeats)])))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "position", *also, *(["positions"] if also else [])]
    return mixed.select(*columns).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), turned AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM totals
), weighed AS (
  SELECT *, [5, 2, 1][turn + 1] AS weight, 2 * source_size AS lim,
    [1.0::DOUBLE, 1.0::DOUBLE, 3.0::DOUBLE][turn + 1] AS w0, [3.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE][turn + 1] AS w1 FROM turned
), leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY lim::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM weighed
), common AS (
  SELECT *, max(CASE WHEN lim::DOUBLE / weight > lev THEN lev END) OVER () AS com FROM leveled
), goals AS (
  SELECT *, CASE WHEN lim::DOUBLE / weight <= lev THEN lim::DOUBLE ELSE com * weight END AS target FROM common
), quotas AS (
  SELECT *, floor(target + 0.5::DOUBLE)::BIGINT AS quota FROM goals
), run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM sized
), mixed AS (
  SELECT r.doc_id, r.source, r.size, q.source_size, q.target, w0, w1, st, quota,
    (least(r.size, greatest(0, quota - st)) + least(r.size, greatest(0, quota - st - q.source_size)))::BIGINT AS taken
  FROM run r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, source, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(2 * (st::DOUBLE / quota * (w0 + w1) / 2)
    / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * (st::DOUBLE / quota * (w0 + w1) / 2))), 9) END AS position
FROM mixed
"""
