"""Hard-negative mining: for an anchor and each of its positives, the best rows of other labels whose score is not too near.

Scores are inner products of integer vectors. An orthogonal rotation to principal components, fitted on a bounded sample,
puts most of a product into its leading components; what is left is at most the product of the two residual norms. Products
are accumulated over the leading components in stages, with that bound and some slack for rounding, and pairs that can't
matter go early. Those that stay are verified by whole integer products, so results are exact whatever the sample.

Anchors are the query set: they go in blocks of a bounded size, by a hash of their row, to the tasks that hold the rows. For
each block the positives are found first, then the negatives. Each search takes a part of the rows first, whose k-th best
score is a bound for all: a task sends few rows that others surpass. No row is shuffled, but what the tasks found.

Rows with a null id, label or vector, or a component that is null or not finite, take no part. A vector that is shorter than
the longest counts as continued by zeros. Rows that repeat a vec_id are rows by themselves: a copy of an anchor may be its
positive. Ties go to the smaller vec_id, then to any row. An empty table gives no rows. Other columns are ignored. Scores
must be under 2^63.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import common

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's must have, at least and at most.
LEAST, MOST = 50, 95
#: Rows that the rotation is fitted on, at most; anchors of a block, about; one in so many rows is searched first.
SAMPLE, BLOCK, FIRST = 4096, 4096, 16
#: Pairs of anchors and rows that are looked at together.
AT_ONCE = 1 << 21


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label and v, the vector in integers, of the rows that take part, with a number _row."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    shifted = F.when(own % 7 == 0, (label + 1) % 10).otherwise(label)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select(own.alias("vec_id"), shifted.alias("label"), v.alias("v"), F.monotonically_increasing_id().alias("_row"))


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Orthogonal, one principal component in each column, those with the largest squares first."""
    return np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1].copy()


def dense(lists: pa.ListArray, width: int) -> np.ndarray:
    size, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Rotated:
    """Integer vectors and their principal components, with the norms of what is left after each stage."""

    def __init__(self, v: np.ndarray, turn: np.ndarray):
        self.v, self.x = v, v @ turn
        width = turn.shape[1]
        self.ends = sorted({max(1, width // 4), max(1, width // 2), width})
        left = np.cumsum((self.x**2)[:, ::-1], axis=1)[:, ::-1]
        self.left = [np.sqrt(left[:, e]) if e < width else np.zeros(len(v)) for e in self.ends]
        self.norm = np.sqrt((self.x**2).sum(1))

    def pairs(self, rows: "Rotated", a: np.ndarray, b: np.ndarray, matters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score): pairs of own vectors in `a` and vectors of `rows` in `b` that still matter, with exact scores.

        matters(i, low, high) says which may matter of pairs whose score lies between low and high."""
        slack = lambda i, j: 1e-9 * (self.norm[i] * rows.norm[j] + 1)
        part = self.x[a][:, : self.ends[0]] @ rows.x[b][:, : self.ends[0]].T
        room = np.multiply.outer(self.left[0][a], rows.left[0][b]) + slack(a[:, None], b[None])
        i, j = np.nonzero(matters(a[:, None], part - room, part + room))
        part, i, j = part[i, j], a[i], b[j]
        for s in range(1, len(self.ends) - 1):
            span = slice(self.ends[s - 1], self.ends[s])
            part = part + np.einsum("nd,nd->n", self.x[i, span], rows.x[j, span])
            room = self.left[s][i] * rows.left[s][j] + slack(i, j)
            keep = matters(i, part - room, part + room)
            i, j, part = i[keep], j[keep], part[keep]
        return i, j, np.einsum("nd,nd->n", self.v[i], rows.v[j])


class Best:
    """The k best (score, vec_id) of each of `n` lists so far, with a bound that was known before."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.of, self.score, self.id, self.other = (np.empty(0, np.int64) for _ in range(4))

    def add(self, of: np.ndarray, score: np.ndarray, vec_id: np.ndarray, other: np.ndarray) -> None:
        of, score, vec_id, other = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.id, vec_id), (self.other, other)))
        order = np.lexsort([vec_id, -score, of])
        sorted_of = of[order]
        first = np.searchsorted(sorted_of, sorted_of)
        place = np.arange(len(order)) - first
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[of[last]] = np.maximum(self.least[of[last]], score[last])
        self.of, self.score, self.id, self.other = of[kept], score[kept], vec_id[kept], other[kept]


class Anchors:
    """A block of anchors. goals: for each anchor its positives' scores, once they are known; NaN for those that it lacks."""

    def __init__(self, vec_id: np.ndarray, label: np.ndarray, row: np.ndarray, v: np.ndarray, turn: np.ndarray):
        self.vec_id, self.label, self.row, self.own = vec_id, label, row, Rotated(v, turn)
        self.goals = np.full((len(vec_id), POSITIVES), np.nan)

    def positives(self, found: Best, rows: Rotated, label: np.ndarray, row: np.ndarray, vec_id: np.ndarray) -> None:
        for x in np.intersect1d(self.label, label):
            i, j, score = self.own.pairs(rows, np.flatnonzero(self.label == x), np.flatnonzero(label == x), lambda i, low, high: high >= found.least[i])
            keep = (self.row[i] != row[j]) & (score >= found.least[i])
            found.add(i[keep], score[keep], vec_id[j[keep]], row[j[keep]])

    def negatives(self, found: Best, rows: Rotated, label: np.ndarray, row: np.ndarray, vec_id: np.ndarray) -> None:
        least = np.maximum(self.goals * LEAST / 100, found.least.reshape(-1, POSITIVES))
        lowest = np.where(np.isnan(self.goals), np.inf, least).min(1)
        highest = np.where(np.isnan(self.goals), -np.inf, self.goals * MOST / 100).max(1)
        for x in np.unique(self.label):
            i, j, score = self.own.pairs(rows, np.flatnonzero(self.label == x), np.flatnonzero(label != x), lambda i, low, high: (high >= lowest[i]) & (low <= highest[i]))
            for k in range(POSITIVES):
                goal = np.nan_to_num(self.goals[i, k]).astype(np.int64)
                keep = ~np.isnan(self.goals[i, k]) & (LEAST * goal <= 100 * score) & (100 * score <= MOST * goal) & (score >= found.least[i * POSITIVES + k])
                found.add(i[keep] * POSITIVES + k, score[keep], vec_id[j[keep]], row[j[keep]])


def searched(rows: DataFrame, anchors: Anchors, turn: np.ndarray, what: str, least: np.ndarray, k: int) -> DataFrame:
    """(list, score, vec_id, row): each task's k best rows of every list. what: positives (a list for each anchor) or
    negatives (one for each anchor and place among its positives)."""
    names, kinds = ["vec_id", "label", "_row"], "list long, score long, vec_id long, row long"

    def run(batches):
        found, chunk = Best(len(least), k, least), max(64, AT_ONCE // max(1, len(anchors.label)))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                vec_id, label, row = (np.asarray(part.column(c)) for c in names)
                getattr(anchors, what)(found, Rotated(dense(part.column("v"), len(turn)), turn), label, row, vec_id)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.of, found.score, found.id, found.other)], ["list", "score", "vec_id", "row"])

    return rows.select(*names, "v").mapInArrow(run, kinds)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k first of every list, numbered from 1: in two steps, so that few tasks' rows of a list meet."""
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    some = found.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("list", "_task").orderBy(*order))).where(F.col("rank") <= k).drop("_task", "rank")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("list").orderBy(*order))).where(F.col("rank") <= k)


def bounds(found: DataFrame, k: int, n: int) -> np.ndarray:
    """The k-th best score of each list, the least integer where there is none."""
    out = np.full(n, np.iinfo(np.int64).min)
    for r in first_of(found, k).where(F.col("rank") == k).select("list", "score").collect():
        out[r["list"]] = r["score"]
    return out


def mined(embeddings: DataFrame, is_anchor: Column, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor is a condition on vec_id.

    The result is written, and what was written for it removed."""
    spark = embeddings.sparkSession
    found = []
    with common.cleared(spark):
        rows = common.written(taking_part(embeddings), "vectors")
        asked = rows.where(is_anchor)
        n_anchors, width = asked.count(), rows.agg(F.max(F.size("v"))).first()[0] or 0
        sample = rows.orderBy(F.xxhash64("vec_id"), "_row").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks() if n_anchors else None
        turn = rotation(dense(sample, width)) if width and n_anchors else np.zeros((0, 0))
        soon = rows.where(F.pmod(F.xxhash64("_row"), F.lit(FIRST)) == 0)
        blocks = math.ceil(n_anchors / block) if width else 0
        for b in range(blocks):
            here = asked.where(F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(blocks)) == b).toArrow()
            if not here.num_rows:
                continue
            anchors = Anchors(*[np.asarray(here[c].combine_chunks()) for c in ("vec_id", "label", "_row")], dense(here["v"].combine_chunks(), width), turn)
            n = here.num_rows
            none = np.full(n, np.iinfo(np.int64).min)
            least = bounds(searched(soon, anchors, turn, "positives", none, POSITIVES), POSITIVES, n)
            ids = np.zeros((n, POSITIVES), np.int64)
            for r in first_of(searched(rows, anchors, turn, "positives", least, POSITIVES), POSITIVES).collect():
                ids[r["list"], r["rank"] - 1], anchors.goals[r["list"], r["rank"] - 1] = r["vec_id"], r["score"]
            least = bounds(searched(soon, anchors, turn, "negatives", np.repeat(none, POSITIVES), NEGATIVES), NEGATIVES, n * POSITIVES)
            best = first_of(searched(rows, anchors, turn, "negatives", least, NEGATIVES), NEGATIVES)
            lists = [(i * POSITIVES + k, int(anchors.vec_id[i]), int(ids[i, k]), int(anchors.goals[i, k])) for i, k in zip(*np.nonzero(~np.isnan(anchors.goals)), strict=True)]
            lists = spark.createDataFrame([(int(a), *x) for a, *x in lists], "list long, anchor_id long, positive_id long, positive_score long")
            best = best.join(F.broadcast(lists), "list").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            found.append(common.written(best, "hard-negatives", keep=True))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) AS place FROM pairs WHERE same) WHERE place <= 5
), ranks AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.other_id, n.other)::INT AS rank
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranks WHERE rank <= 3
"""
