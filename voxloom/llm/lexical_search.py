"""Ranked lexical search: the k highest-scoring documents for each item of a query set, by inverted treaps.

The corpus is an index in shards, each held by one task. For every term a shard has a treap of its documents: a binary
search tree by document, and a heap by impact, the part of the score that term and document give. A search walks the
treaps of an item's terms together. A state is a range of documents with the root of each treap's part in it; the sum of
the roots' impacts bounds every score in the range, so a range whose bound is below the k-th best score goes, with all
that is under it. Others are split at one root's document, which is scored. Ranges with the largest bounds come first.

Items are taken in blocks by a hash of their texts; a block's terms are sent to all tasks. Documents are read and cut into
words once for each block, and only counts of the block's terms are written. No posting is shuffled: tasks send their k best
for each item. Collection statistics cover all documents.

Null and empty texts have no terms: such documents have no score, and such items no rows. Each row of the items is an item by
itself, whether its id is repeated or null, and each document row a document; equal scores come by doc_id, null last, then in
any order. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import common

BEST = 50
#: Postings of a shard, and documents, about. Characters of the items of a block, about.
SHARD_POSTINGS, SHARD_DOCS, BLOCK_CHARS = 2_000_000, 65_536, 2_000_000
#: States that are split at once, at most.
AT_ONCE = 2048
#: Bytes of ASCII that are in no term become spaces, capitals small letters; all others stay.
TERM_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode().translate(TERM_BYTES).split()


def known_terms(texts: list[str | None], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The id of every word of some texts, -1 for others than those in `ids`; and where each text starts, the end included."""
    split = [terms(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    get = ids.get
    return np.fromiter((get(w, -1) for x in split for w in x), np.int32, starts[-1]), starts


def counted(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of `ids` that it has: their numbers and how often each comes."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.in_pieces(texts):
                found, starts = known_terms(texts[a:b], ids)
                doc = np.repeat(np.arange(b - a), np.diff(starts))
                key, tf = np.unique((doc * len(ids) + found)[found >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(b - a + 1) * max(len(ids), 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % max(len(ids), 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(starts)), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's share of a document's score, before the term's weight."""
    m = 50 + (50 * n * documents) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Treaps:
    """One treap for each of `n_terms` terms, from postings (term, doc, impact) that are sorted by term and document.

    Nodes are places in the postings; `none` stands for no node and has no impact. Of equal impacts the first document is
    above the others."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        n = self.none = len(doc)
        above = np.append(impact, np.iinfo(np.int64).max)
        first = np.append(np.searchsorted(term, np.arange(n_terms)), n)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[first[:-1][np.diff(first) > 0]] = n
        after[first[1:][np.diff(first) > 0] - 1] = n
        before = self.nearest(np.append(before, n), above, lambda x, own: x < own)
        after = self.nearest(np.append(after, n), above, lambda x, own: x <= own)
        # of the two nearest nodes that are higher, the lower one is the parent
        right = above[before] < above[after]
        own = np.arange(n)
        self.left, self.right, root = np.full(n + 1, n), np.full(n + 1, n), (before[:n] == n) & (after[:n] == n)
        self.right[before[:n][right[:n]]] = own[right[:n]]
        is_left = ~right[:n] & ~root
        self.left[after[:n][is_left]] = own[is_left]
        self.root = np.full(n_terms, n)
        self.root[term[root]] = own[root]
        self.left[n] = self.right[n] = n
        self.doc, self.impact = np.append(doc, -1), np.append(impact, 0)

    @staticmethod
    def nearest(at: np.ndarray, height: np.ndarray, lower) -> np.ndarray:
        """From the neighbour `at` of each node, jump on to the nearest that isn't lower; all nodes at once."""
        todo = np.flatnonzero(lower(height[at], height)[:-1])
        while len(todo):
            at[todo] = at[at[todo]]
            todo = todo[lower(height[at[todo]], height[todo])]
        return at

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Descend until each node's document lies between low and high, both excluded. Changes `node`."""
        flat = node.reshape(-1)
        low, high = np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
        todo = np.flatnonzero(flat != self.none)
        while len(todo):
            at = flat[todo]
            d = self.doc[at]
            small, large = d <= low[todo], d >= high[todo]
            moved = small | large
            todo, at = todo[moved], at[moved]
            at = np.where(small[moved], self.right[at], self.left[at])
            flat[todo] = at
            todo = todo[at != self.none]
        return node


class Shard:
    """Some documents' counts, by document and as treaps."""

    def __init__(self, doc_id: list, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, documents: int, length: int):
        order = np.argsort(np.array([np.iinfo(np.int64).max if x is None else x for x in doc_id], np.int64), kind="stable")
        self.doc_id = [doc_id[i] for i in order]
        size = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts[:-1][order] - self.starts[:-1], size) + np.arange(self.starts[-1])
        self.term, doc = term[at], np.repeat(np.arange(len(order)), size)
        self.impact = impacts(tf[at].astype(np.int64), n[order][doc], documents, length)
        by_term = np.argsort(self.term, kind="stable")
        self.treaps = Treaps(self.term[by_term], doc[by_term], self.impact[by_term], n_terms)
        self.weights = np.zeros(n_terms, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """With self.weights, which are 0 but for the item's terms."""
        size = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.starts[docs] - (ends - size), size) + np.arange(ends[-1])
        total = np.concatenate([[0], np.cumsum(self.weights[self.term[at]] * self.impact[at])])
        return total[ends] - total[ends - size]

    def best(self, item: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores above 0, the k best at least that come first, in order. Documents are places in doc_id."""
        t = self.treaps
        here = t.root[item] != t.none
        item, weights = item[here], weights[here]
        got, score = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(item):
            return got, score
        self.weights[item] = weights
        node, low, high = t.root[item][None], np.array([-1]), np.array([len(self.doc_id)])
        bound, least, at_once = (t.impact[node] * weights).sum(1), 1, k
        while len(bound):
            first = np.argpartition(-bound, at_once - 1)[:at_once] if len(bound) > at_once else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[first] = False
            n, lo, hi = node[first], low[first], high[first]
            split = t.doc[n[np.arange(len(n)), (t.impact[n] * weights).argmax(1)]]
            got, score = np.append(got, split), np.append(score, self.scores(split))
            if len(got) > k:
                order = np.lexsort([got, -score])[:k]
                got, score = got[order], score[order]
                least = max(1, score[-1])
            both = t.within(np.concatenate([n, n]), np.concatenate([lo, split]), np.concatenate([split, hi]))
            node = np.concatenate([node[rest], both])
            low, high = np.concatenate([low[rest], lo, split]), np.concatenate([high[rest], split, hi])
            bound = np.concatenate([bound[rest], (t.impact[both] * weights).sum(1)])
            keep = bound >= least
            node, low, high, bound, at_once = node[keep], low[keep], high[keep], bound[keep], min(AT_ONCE, 2 * at_once)
        self.weights[item] = 0
        order = np.lexsort([got, -score])
        order = order[score[order] > 0]
        return got[order], score[order]


def best_in_shards(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each shard for each item, given by its terms and their weights."""

    def search(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        size = np.asarray(table.column("terms").combine_chunks().value_lengths())
        term, tf = (np.asarray(table.column(c).combine_chunks().flatten()) for c in ("terms", "tf"))
        shard = Shard(table.column("doc_id").to_pylist(), np.asarray(table.column("n")), np.concatenate([[0], np.cumsum(size)]), term, tf, n_terms, documents, length)
        found = [(i, *shard.best(*item, k)) for i, item in enumerate(items)]
        docs = [shard.doc_id[d] for _, got, _ in found for d in got.tolist()]
        which = np.concatenate([np.full(len(got), i, np.int32) for i, got, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(docs, pa.int64()), pa.array(np.concatenate([s for *_, s in found]))], ["item", "doc_id", "score"])

    def run(batches):
        held, postings, docs = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            postings, docs = postings + len(batch.column("terms").flatten()), docs + batch.num_rows
            if postings >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                yield search(held)
                held, postings, docs = [], 0, 0
        if held:
            yield search(held)

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item int, doc_id long, score long") if items else rows.sparkSession.createDataFrame([], "item int, doc_id long, score long")


def first_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """With rank, the k rows of each item that come first."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score. items: item_id, text.

    The result is written, and what was written for it removed."""
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType
    blocks = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars)
    found = []
    with common.cleared(spark):
        for block in range(blocks):
            here = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).select("item_id", "text").collect()
            asked = [(r.item_id, sorted(set(terms(r.text)))) for r in here]
            ids = {w: i for i, w in enumerate(sorted({w for _, x in asked for w in x}))}
            rows = common.written(counted(docs, ids).where("n > 0"), "term-counts")
            documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = {r.term: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
            numbers = [np.array([ids[w] for w in x], np.int64) for _, x in asked]
            weighed = [(x, np.array([weight(df.get(i, 0), documents) for i in x.tolist()], np.int64)) for x in numbers]
            best = best_in_shards(rows, weighed, len(ids), documents, length, k)
            best = first_of(best.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(64))), ["item", "_task"], k)
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], f"item int, item_id {item_type.simpleString()}")
            best = first_of(best.drop("rank"), ["item"], k).join(F.broadcast(names), "item")
            found.append(common.written(best.select("item_id", "rank", "doc_id", "score"), "ranked", keep=True))
            common.removed(rows)
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT rowid AS doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), postings AS (
  SELECT doc, doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT doc, sum(tf)::BIGINT AS n FROM postings GROUP BY doc
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM sizes
), asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scores AS (
  SELECT item, item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc), total GROUP BY ALL
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
"""
