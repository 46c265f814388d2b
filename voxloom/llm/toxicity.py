"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its lower-cased words, their first four and five characters, word pairs, and pairs that skip one
or two words, hashed into 2^20 buckets and counted once each. Each coordinate has its own learning rate, and L1 keeps
the weights that little evidence supports at exactly zero: what is broadcast is the few that are left, 12 bytes each, at
most one for each bucket. Labels, language, source and id are no features.

Training takes a bounded sample of the labelled rows, by smallest hashed id; features are extracted in parallel, and one
task runs the updates in a fixed order, so equal input gives equal weights. Scoring covers every row by itself.

Null and empty texts are scored by the bias alone. Without labelled rows every score is 0.5. Rows labelled twice count
as toxic if any label says so; labels that are null, or of no id, are left out. Documents that repeat an id are all learned
from and scored by themselves, equal texts alike, with an id or without; further columns have no influence, and an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import common

BITS = 20
#: At most so many labelled rows are learned from.
MOST_LABELLED = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.3, 1.0, 12.0, 0.1
#: How much more a toxic example's gradient counts, as there are fewer of them.
TOXIC_WEIGHT = 8.0
THRESHOLD = 0.7
BIAS = 1 << BITS
WORD = re.compile(r"[^\W_]+")


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all features of some texts, repeats included."""
    from xxhash import xxh64_intdigest

    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    count = np.array([len(x) for x in found], np.int64)
    flat = [w for x in found for w in x]
    row = np.repeat(np.arange(len(texts)), count)
    if not flat:
        return row, np.empty(0, np.int64)
    whole = np.fromiter(map(xxh64_intdigest, flat), np.uint64, len(flat))
    rows, keys = [row], [whole]
    for k in (4, 5):
        cut = np.fromiter((xxh64_intdigest(w[:k]) for w in flat), np.uint64, len(flat))
        rows.append(row)
        keys.append(cut * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    for gap in (1, 2, 3):
        same = row[:-gap] == row[gap:]
        rows.append(row[gap:][same])
        keys.append(((whole[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (whole[gap:] * np.uint64(0x165667B19E3779F9 + 2 * gap)))[same])
    key = np.concatenate(keys)
    key ^= key >> np.uint64(32)
    return np.concatenate(rows), (key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, toxic_weight: float = TOXIC_WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with non-zero weights, and the weights. Rows are (distinct buckets, label); the bias has no L1."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        pull = np.where(i == BIAS, 0.0, l1)
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y in rows:
            i = np.append(i, BIAS)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (toxic_weight if y else 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    used = np.flatnonzero(n)
    w = weight(used)
    return used[w != 0], w[w != 0]


def scores(texts: list[str | None], dense: np.ndarray) -> np.ndarray:
    """Scores of some texts. dense: the weight of each bucket, the bias last."""
    row, bucket = features(texts)
    hit = np.flatnonzero(dense[bucket])
    pairs = np.unique(row[hit] * (BIAS + 1) + bucket[hit])
    total = np.bincount(pairs // (BIAS + 1), dense[pairs % (BIAS + 1)], minlength=len(texts)) + dense[BIAS]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from at most `most` labelled documents that aren't held out."""
    sample = (
        labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .withColumn("_order", F.xxhash64("doc_id"))
        .orderBy("_order", "doc_id")
        .limit(most)
    )

    def extract(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = []
            for a, b in common.in_pieces(texts):
                row, bucket = features(texts[a:b])
                pairs = np.unique(row * BIAS + bucket)
                at = np.searchsorted(pairs, np.arange(b - a + 1) * BIAS)
                found += [(pairs[i:j] % BIAS).astype(np.int32) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_toxic"), pa.array(found, pa.list_(pa.int32()))], ["_order", "_toxic", "found"])

    def learn(batches):
        rows = [(x.values.to_numpy().astype(np.int64), y) for b in batches for x, y in zip(b.column("found"), b.column("_toxic").to_pylist(), strict=True)]
        i, w = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.float64())], ["i", "w"])

    extracted = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("_order", "_toxic", "text").mapInArrow(extract, "_order long, _toxic int, found array<int>")
    got = extracted.repartition(1).sortWithinPartitions("_order", "_toxic", "found").mapInArrow(learn, "i long, w double").toPandas()
    return got["i"].to_numpy(), got["w"].to_numpy()


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        dense = np.zeros(BIAS + 1)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = np.concatenate([scores(texts[a:b], dense) for a, b in common.in_pieces(texts)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = judge(docs, fit(docs, common.labels(spark, sf_dir)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
