"""Near duplicates: HyperMinHash sketches, banded for candidates, with exact confirmation and connected components.

A text's set is its distinct word shingles. Each of 128 registers keeps the smallest of one hash of them, as a
leading-zero count and ten mantissa bits. Four registers make a band of 64 bits, and texts that agree in a band are
candidates: at the threshold of 0.8 a pair shares none of the 32 bands with probability 5e-8. Candidates whose
collision-corrected estimate lies within four standard errors of the threshold, or above, are confirmed on full sets.

One permutation dealt over the registers would be cheaper, but leaves most registers of a short text empty; bands of one
full register then gather all texts with a common shingle. So every register has a hash of its own.

Equal sets are one class from the start. All members of a band's group are first compared with one of them, its pivot,
which links most copies at the cost of one pair each (the text whose shingles most others have). Groups that still hold several components are split further: their
texts' shingles are ordered by how many of those texts have them, rarest first, and two sets can only be similar enough
if they share a shingle early enough in both orders (prefix and position filter; it loses no pair). Texts of one template
with words of their own share only shingles that come late, so they don't meet. Pairs that meet go through estimate and
confirmation like the others. Pairs still grow faster than the texts where very many lie just below the threshold of each
other: each of those has to be looked at.

Null and empty texts have the empty set and are linked with nothing. A null doc_id is linked with nothing and has no
component. Rows that repeat a doc_id are documents by themselves; with equal texts they are in the same component. Ties
go to the smallest doc_id, then to the smallest hash of the text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import common, graph

REGISTERS, MANTISSA_BITS = 128, 10
#: Texts that share an early shingle are compared in blocks of about so many.
BLOCK = 512
#: Standard errors that an estimate may lie below the threshold.
MARGIN = 4


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, (2, REGISTERS), np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers for each set; 0 for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.flatnonzero([len(x) > 0 for x in sets])
    if not len(full):
        return out
    h = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    least = np.empty((len(full), REGISTERS), np.uint64)
    for i, (times, plus) in enumerate(multipliers().T):
        x = h * times
        x ^= plus
        least[:, i] = np.minimum.reduceat(x, starts)
    part, exponent = np.frexp((least >> np.uint64(12)).astype(np.float64))
    mantissa = np.where(part > 0, (part * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out[full] = ((53 - exponent) << MANTISSA_BITS) | mantissa
    return out


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from two arrays of registers of sets with n and m members.

    Registers of unrelated sets agree by chance: cells at x are about 0.72 * x / 2^mantissa wide, and the two minima
    fall into one cell with probability 0.72 / 2^mantissa * n * m / (n + m)^2."""
    same = (x == y).mean(1)
    chance = 0.7213 / (1 << MANTISSA_BITS) * n * m / np.maximum(n + m, 1) ** 2
    return np.clip((same - chance) / (1 - chance), 0, 1)


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, k: int, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, hash (of the text), n (set size), set_key (128 bits, equal for equal sets; null for empty ones), bands; and
    the columns `also`."""
    kept = ["doc_id", "hash", *also]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), *also, "text")
    given = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.in_pieces(texts):
                sets = [shingles(t, k) for t in texts[a:b]]
                bands = registers(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c)[a:b] for c in kept],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), bands.reshape(-1)),
                    ],
                    [*kept, "n", "set_key", "bands"],
                )

    return rows.mapInArrow(run, f"{given}, n long, set_key binary, bands array<long>")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule the threshold out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("bands").alias(f"bands_{x}"), F.col("n").alias(f"n_{x}"))
    sizes = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.asarray(batch.column(f"bands_{c}").flatten()).view(np.uint16).reshape(-1, REGISTERS) for c in "ab")
            n, m = (np.asarray(batch.column(f"n_{c}")).astype(float) for c in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y, n, m) >= least_estimate(threshold)))

    return pairs.join(side("b"), "b").join(side("a"), "a").where(sizes).select("a", "b", "bands_a", "bands_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for a, t, u in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, held = a, shingles(t.as_py(), k)
                other = shingles(u.as_py(), k)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def grouped(placed: DataFrame) -> DataFrame:
    """id, band, key and members, the group's size, for the groups with several members."""
    groups = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("n", F.col("members"))
    return common.join_each(placed, common.written(groups, "groups"), ["band", "key"], "n")


def pivot_pairs(members: DataFrame, shares: DataFrame) -> DataFrame:
    """(a, b): for each group its pivot with the other members, once each. shares: (id, shared).

    The pivot is the member whose shingles most other texts have: what copies were made from rather than one of them, so
    most groups of a text have the same one and it links more of them than any other would."""
    placed = members.select("id", "band", "key").join(shares, "id", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    placed = common.written(placed, "shared-members")
    best = placed.groupBy("band", "key").agg(F.max(F.struct("shared", (-F.col("id")).alias("last"))).alias("x"), F.count(F.lit(1)).alias("n"))
    pivots = common.written(best.select("band", "key", (-F.col("x.last")).alias("pivot"), "n"), "pivots")
    pairs = common.join_each(placed, pivots, ["band", "key"], "n").where("id <> pivot")
    return pairs.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()


def still_open(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, component) of the members of groups that hold several components."""
    now = common.written(members.select("id", "band", "key").join(linked, "id", "left").select("id", "band", "key", F.coalesce("component", "id").alias("component")), "now")
    several = now.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    several = common.written(several.where("low < high").select("band", "key", "n"), "several")
    return common.join_each(now, several, ["band", "key"], "n").select("id", "component").distinct()


def exploded(texts: DataFrame, k: int) -> DataFrame:
    """From (id, text): id, n and s, one row for each of the n shingles."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.in_pieces(texts, common.BATCH_CHARS // 8):
                sets = [shingles(t, k) for t in texts[a:b]]
                sizes = np.array([len(x) for x in sets], np.int64)
                ids = np.repeat(np.asarray(batch.column("id"))[a:b], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "s"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, s long")


def orders(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """From (id, text): id, n, shared and early. Texts that share no shingle are left out.

    A text's shingles are ordered by the number of texts that have them, then by their hash. early: structs (s, pos) of
    those that come early enough to decide on a pair, pos counted from 0; shingles of no other text come first and are
    counted only. shared: the mean logarithm of those numbers."""
    rows = common.written(exploded(texts, k), "shingles")
    often = common.written(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often").withColumn("n_s", F.col("c"))
    lists = common.join_each(rows, often, ["s"], "n_s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("x"))
    alone = (F.col("n") - F.size("x")).cast("int")
    early = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    shared = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.log(x["c"])) / F.col("n")
    decisive = F.transform(F.slice("x", F.lit(1), F.greatest(early - F.col("alone"), F.lit(0))), lambda x, i: F.struct(x["s"].alias("s"), (F.col("alone") + i).alias("pos")))
    return lists.withColumn("alone", alone).select("id", "n", shared.alias("shared"), decisive.alias("early"))


def close_pairs(opened: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that sizes and orders of shingles don't rule out. opened: (id, component).

    A shingle that many texts have early is dealt to pairs of blocks of them, so no task holds all of its texts."""
    early = common.written(ordered.join(opened, "id").select("id", "component", "n", F.explode("early").alias("x")).select("id", "component", "n", "x.*"), "early")
    by_shingle = early.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    met = common.written(by_shingle.where("low < high").select("s", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "met")
    placed = common.join_each(early, met, ["s"], "m").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = common.written(placed, "placed")
    columns = ["s", "id", "n", "pos", "component"]
    x = placed.select(*columns, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j")).alias("x")
    y = placed.select(*columns, F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i")).alias("y")
    common_least = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("s", "i", "j")]
    meet += [F.col("x.component") != F.col("y.component"), (F.col("x.i") < F.col("x.j")) | (F.col("x.id") < F.col("y.id"))]
    meet += [100 * F.col(f"{p}.n") >= percent * F.col(f"{q}.n") for p, q in ("xy", "yx")]
    meet += [F.col(f"{p}.pos") + common_least <= F.col(f"{p}.n") for p in "xy"]
    return x.join(y, meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def linked_components(docs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """From the documents and their sketches: of every class set_key, component, component_id (its smallest doc_id), rows."""
    threshold = percent / 100
    by_set = found.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
    classes = by_set.agg(F.min(F.struct("doc_id", "hash", "n", "bands")).alias("x"), F.count(F.lit(1)).alias("rows"))
    classes = common.written(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "x.*", "rows"), "classes")
    placed = classes.select("id", F.posexplode("bands").alias("band", "key"))
    members = common.written(grouped(placed), "members")
    in_groups = classes.join(members.select("id").distinct(), "id").select("id", "doc_id", "hash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    texts = common.written(own.join(in_groups, ["doc_id", "hash"]).dropDuplicates(["id"]).select("id", "text"), "candidates", codec="zstd")

    def links(pairs: DataFrame) -> DataFrame:
        return confirmed(likely(pairs, classes, threshold), texts, k, percent)

    ordered = common.written(orders(texts, k, percent), "orders")
    linked = graph.components(links(pivot_pairs(members, ordered.select("id", "shared"))))
    opened = common.written(still_open(members, linked), "open")
    more = links(close_pairs(opened, ordered, percent)).unionByName(linked.select(F.col("component").alias("a"), F.col("id").alias("b")))
    linked = graph.components(more)
    of_class = common.written(classes.join(linked, "id", "left").select("set_key", "doc_id", "rows", F.coalesce("component", "id").alias("component")), "of-class")
    least = common.written(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    return common.join_each(of_class.drop("doc_id"), least, ["component"], "n")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; and the columns `also`, if any are named, with
    component, which tells components of equal smallest ids apart (null for rows without words or id)."""
    found = common.written(sketches(docs, k, also), "sketches")
    with common.cleared(docs.sparkSession):
        component = common.written(linked_components(docs, found, k, percent), "component", keep=True)
    known = common.join_each(found, component, ["set_key"], "rows").where("doc_id IS NOT NULL")
    rest = found.where("set_key IS NULL OR doc_id IS NULL").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    every = known.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *also, *(["hash", "component"] if also else []))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as the query's contract has them; near_duplicates() itself takes five words."""
    return near_duplicates(common.documents(spark, sf_dir), k=2, percent=80)
