"""Benchmark decontamination: words of documents inside an occurrence of an item's phrases, by an FM-index for each shard.

A phrase is a window of 10 consecutive words of an item; an item of fewer words is one phrase. Tasks gather documents into
shards. A shard's index is a compressed FM-index over their words, with every 32nd suffix position sampled: all phrases are
searched backwards in step by ranks in its wavelet matrix, occurrences are located by walking to a sampled position, and
the spans of each document are merged.

Only stretches that can hold a phrase are indexed: words that some item has, as long as each pair of neighbours occurs in
items too (by a table of hashed pairs, so some more are kept), and that are no shorter than the shortest phrase. The index
decides on all occurrences.

Items are taken in blocks by a hash of their texts; a block's words and phrases are sent to all tasks. With one block
nothing is shuffled; with several, what the blocks find in a document is merged by its id and a hash of its text.

Null and empty texts have no words, so they are not hit, and items of them have no phrases. Rows that repeat an item_id are
one item with the phrases of each; phrases of an item without an id are hit, but it is neither listed nor counted. Each
document row has its own result, whether its id is repeated or null. Empty tables give no rows or no hits. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import common
from voxloom.llm.fm_index import FMIndex
from voxloom.llm.lexical_search import known_terms, terms

WINDOW = 10
#: Words of a shard's index, and documents, about. Characters of the items of a block, about.
SHARD_WORDS, SHARD_DOCS, BLOCK_CHARS = 500_000, 50_000, 2_000_000
#: Hashed pairs of neighbours.
PAIR_SLOTS = 1 << 22


class Phrases:
    """The phrases of some items, each once, over numbered words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        split = [terms(text) for _, text in items]
        self.ids = {w: i for i, w in enumerate(sorted({w for x in split for w in x}))}
        self.of: dict[tuple[int, ...], set[str]] = {}
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        for (item, _), words in zip(items, split, strict=True):
            x = [self.ids[w] for w in words]
            for i in range(max(1, len(x) - window + 1) if x else 0):
                self.of.setdefault(tuple(x[i : i + window]), set()).update([item] if item is not None else [])
            a = np.array(x, np.int64)
            self.pairs[self.slots(a[:-1], a[1:])] = True
        self.shortest = min(map(len, self.of), default=0)
        by_length: dict[int, list[int]] = {}
        self.items = list(self.of.values())
        for i, x in enumerate(self.of):
            by_length.setdefault(len(x), []).append(i)
        every = list(self.of)
        self.by_length = [(np.array(i), np.array([every[k] for k in i], np.int64)) for i in by_length.values()]

    @staticmethod
    def slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)

    def stretches(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the numbered words (-1: no item's) of some texts: first word and length of what may hold a phrase."""
        known = words >= 0
        on = np.zeros(len(words), bool)  # whether a word goes on what the one before it began
        on[1:] = known[1:] & known[:-1]
        at = np.flatnonzero(on)
        on[at] = self.pairs[self.slots(words[at - 1], words[at])]
        on[starts[:-1][np.diff(starts) > 0]] = False
        first = np.flatnonzero(known & ~on)
        ends = np.append(np.flatnonzero(~on), len(words))
        size = ends[np.searchsorted(ends, first, "right")] - first
        return first[size >= self.shortest], size[size >= self.shortest]


def occurrences(sequences: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of all occurrences in the sequences; places count each one's words and an end."""
    index = FMIndex([x + 1 for x in sequences], np.ones(len(sequences), np.int64), len(phrases.ids), sum(map(len, sequences)) + len(sequences), sample=32)
    which, place = [], []
    for number, words in phrases.by_length:
        lane, low, high = index.search(words + 1)
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which.append(np.repeat(number[lane], n))
        place.append(index.locate(rows))
    return np.concatenate(which), np.concatenate(place)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, in order; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def search(held: dict[str, list], phrases: Phrases) -> pa.RecordBatch:
    """held: doc_id, hash and n_words of documents; doc, first (word) and words of their stretches."""
    n_docs = len(held["n_words"])
    spans: list[list] = [[] for _ in range(n_docs)]
    items: list[set] = [set() for _ in range(n_docs)]
    if held["words"]:
        which, place = occurrences(held["words"], phrases)
        size = np.array([len(x) + 1 for x in held["words"]])
        ends = np.cumsum(size)
        stretch = np.searchsorted(ends, place, "right")
        doc, first = np.array(held["doc"])[stretch], np.array(held["first"])[stretch] + place - (ends - size)[stretch]
        long = np.zeros(len(phrases.items), np.int64)
        for number, words in phrases.by_length:
            long[number] = words.shape[1]
        for key in np.unique(doc * len(phrases.items) + which).tolist():
            items[key // len(phrases.items)] |= phrases.items[key % len(phrases.items)]
        if len(place):  # spans of all documents in one line, a word apart
            offset = np.concatenate([[0], np.cumsum(np.array(held["n_words"]) + 1)])
            a, b = merged(offset[doc] + first, offset[doc] + first + long[which])
            for d, x, y in zip((np.searchsorted(offset, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
                spans[d].append({"start": x - int(offset[d]), "end": y - int(offset[d])})
    columns = [pa.array(held["doc_id"], pa.int64()), pa.array(held["hash"], pa.int64()), pa.array(held["n_words"], pa.int64())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([*columns, pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "hash", "n_words", "spans", "items"])


def found_in(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """doc_id, hash (of the text), n_words, spans and items (of which a phrase occurs) for each row of docs."""

    def shards(batches):
        new = lambda: {k: [] for k in ("doc_id", "hash", "n_words", "doc", "first", "words")}
        held, size = new(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.in_pieces(texts):
                words, starts = known_terms(texts[a:b], phrases.ids)
                first, length = phrases.stretches(words, starts)
                doc = np.searchsorted(starts, first, "right") - 1
                held["doc"] += (doc + len(held["n_words"])).tolist()
                held["first"] += (first - starts[doc]).tolist()
                held["words"] += [words[i : i + n].astype(np.int64) for i, n in zip(first.tolist(), length.tolist(), strict=True)]
                held["n_words"] += np.diff(starts).tolist()
                for c in ("doc_id", "hash"):
                    held[c] += batch.column(c)[a:b].to_pylist()
                size += int(length.sum())
                if size > SHARD_WORDS or len(held["n_words"]) > SHARD_DOCS:
                    yield search(held, phrases)
                    held, size = new(), 0
        if held["n_words"]:
            yield search(held, phrases)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(shards, "doc_id long, hash long, n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>")


def union_of(spans) -> F.Column:
    """Sorted spans, those that meet as one."""
    grown = lambda out, x: F.when(
        F.size(out) > 0, F.when(x["start"] <= F.element_at(out, -1)["end"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x)))
    ).otherwise(F.array(x))
    return F.aggregate(F.sort_array(spans), F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)"), grown)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, hash, n_words, n_hit, spans (word ranges to remove, ends excluded) and items (sorted ids) for each row of docs.

    items: item_id, text. Rows of one doc_id and hash have one text and so one result."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    found = []
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        found.append(found_in(docs, Phrases([tuple(r) for r in here], window)))
    rows = found[0]
    if blocks > 1:
        rows = common.written(rows, "phrases-found")
        more = rows.where("size(items) > 0 OR size(spans) > 0")
        for x in found[1:]:
            more = more.unionByName(common.written(x.where("size(items) > 0 OR size(spans) > 0"), "phrases-found"))
        of_doc = more.groupBy("doc_id", "hash").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).alias("m")
        same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.hash") == F.col("m.hash"))
        empty = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")
        rows = rows.alias("r").join(of_doc, same, "left").select("r.doc_id", "r.hash", "n_words", F.coalesce("m.spans", empty).alias("spans"), F.coalesce(F.sort_array("m.items"), F.expr("CAST(array() AS array<string>)")).alias("items"))
        rows = rows.withColumn("spans", union_of(F.col("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "hash", "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the words that no occurrence covers, joined by a space, for each row of docs. Words are lower-cased."""

    def drop(batches):
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, at = terms(text), 0
                left = []
                for x in spans or []:
                    left += words[at : x["start"]]
                    at = x["end"]
                kept.append(b" ".join(left + words[at:]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    hit = contaminated(docs, items, window).where("n_hit > 0").dropDuplicates(["doc_id", "hash"]).alias("m")
    joined = rows.alias("r").join(hit, F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.hash") == F.col("m.hash")), "left")
    return joined.select("r.doc_id", "r.text", "m.spans").mapInArrow(drop, "doc_id long, kept string")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, words[i : i + 9] AS phrase FROM item_words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS t(i) WHERE len(words) > 0
), sizes AS (
  SELECT DISTINCT len(phrase) AS k FROM phrases
), windows AS (
  SELECT doc, i, words[i : i + k - 1] AS phrase, k FROM doc_words, sizes, unnest(range(1, len(words) - k + 2)) AS t(i)
), hits AS (
  SELECT doc, i, k, item_id FROM windows JOIN phrases USING (phrase)
), hit_words AS (
  SELECT doc, count(DISTINCT w) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(w) GROUP BY doc
), hit_items AS (
  SELECT doc, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc) LEFT JOIN hit_items USING (doc)
"""
