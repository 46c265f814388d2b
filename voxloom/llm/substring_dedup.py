"""Substring dedup: words covered by a window of 35 words that also occurs elsewhere are removed.

Every window is filed under an anchor, the smallest hash of the word groups in it; neighbours with the same anchor form
a run. Equal windows have equal anchors, so only the runs of anchors that come twice or more are looked at further. Equal
runs are counted together, one of each is cut out of its document, and all runs of an anchor go to one shard. A shard
builds a compressed FM-index of its runs and streams them through it: backward search over the wavelet matrix follows
the longest matches leftwards and reports the windows with two occurrences or more, counted with the runs' multiplicity.

An anchor with very many different runs would fill a shard. Its runs are cut into single windows, each filed under its
own hash, equal ones counted together, which spreads them over all shards; the index of the shard decides on them too.

Null and empty texts have no words. Every row is a document by itself: rows are told apart by doc_id and a hash of the
text, so different texts may share an id, and rows without an id are treated like the others. Rows that repeat id and text
are occurrences like any other. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import common
from voxloom.llm.fm_index import FMIndex

WINDOW, GRAM = 35, 8
#: An anchor with more different runs than this is cut into windows. Words of one FM-index, about.
MOST_RUNS, SHARD_WORDS = 4000, 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of some texts, and where each text starts among them, the end included."""
    from xxhash import xxh64_intdigest

    split = [t.encode().split() if t else [] for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    return np.fromiter((xxh64_intdigest(w) for x in split for w in x), np.uint64, starts[-1]), starts


def joined_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k items."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mixed(out)


def least(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of every k neighbours, by doubling."""
    span = 1
    while span * 2 <= k:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (k - span)], x[k - span :]) if k > span else x


def anchored_runs(h: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The windows of some texts, cut into runs of neighbours with the same anchor.

    A window's anchor is the smallest hash of the word groups within it, so equal windows have equal anchors. A run has at
    most as many windows as an anchor can be in. Returns text, start (word, within all), n (windows), anchor, twice
    (whether a window occurs twice within the run)."""
    span = window - gram + 1
    if len(h) < window:
        return {k: np.empty(0, np.int64) for k in ("text", "start", "n")} | {"anchor": np.empty(0, np.uint64), "twice": np.empty(0, bool)}
    anchor = least(joined_hashes(h, gram), span)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(text[: len(anchor)] == text[window - 1 : window - 1 + len(anchor)])
    key, of = anchor[at], text[at]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    new |= place % span == 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    run = np.repeat(np.arange(len(first)), size)
    whole = joined_hashes(h, window)[at]
    twice = np.zeros(len(first), bool)
    for d in range(1, span):
        twice[run[d:][(whole[d:] == whole[:-d]) & (run[d:] == run[:-d])]] = True
    return {"text": of[first], "start": at[first], "n": size, "anchor": key[first], "twice": twice}


def run_hashes(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """A hash of all words of each run, from those of its first and last window and windows in between."""
    whole = joined_hashes(h, window)
    out = mixed(sizes.astype(np.uint64))
    for part in (0, 1 / 2, 1):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + whole[starts + ((sizes - 1) * part).astype(np.int64)])
    return out


def runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, run, key, hash, start, n, w): start in words of the document, run a hash of the run's words, w 2 if it has a
    window twice."""

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in common.in_pieces(texts):
                h, starts = hashed_words(texts[a:b])
                got = anchored_runs(h, starts, window, gram)
                if not len(got["n"]):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(got["anchor"].view(np.int64)),
                        pa.array(run_hashes(h, got["start"], got["n"], window).view(np.int64)),
                        *[batch.column(c)[a:b].take(pa.array(got["text"])) for c in ("key", "hash")],
                        pa.array((got["start"] - starts[got["text"]]).astype(np.int32)),
                        pa.array(got["n"].astype(np.int32)),
                        pa.array(got["twice"].astype(np.int32) + 1, pa.int32()),
                    ],
                    ["anchor", "run", "key", "hash", "start", "n", "w"],
                )

    return docs.select("key", "hash", "text").mapInArrow(cut, "anchor long, run long, key long, hash long, start int, n int, w int")


def cut_out(docs: DataFrame, witnesses: DataFrame, window: int) -> DataFrame:
    """The words of each witness (key, hash, start, n, anchor, run, weight, cut), or of its windows one by one if cut.

    Returns (anchor, run, at, route, words, weight): at is the place of a window within its run, -1 for a whole run, and
    route what decides on the shard."""
    wanted = witnesses.groupBy("key", "hash").agg(F.collect_list(F.struct("anchor", "run", "start", "n", "weight", "cut")).alias("wanted"))

    def take(batches):
        from xxhash import xxh64_intdigest

        names = ["anchor", "run", "at", "route", "words", "weight"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            for a, b in common.in_pieces(batch.column("text").to_pylist()):
                rows = []
                for text, wanted in zip(batch.column("text")[a:b].to_pylist(), batch.column("wanted")[a:b].to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    for x in wanted:
                        start, n = x["start"], x["n"]
                        if not x["cut"]:
                            rows.append((x["anchor"], x["run"], -1, x["anchor"], b" ".join(words[start : start + n + window - 1]), x["weight"]))
                            continue
                        for i in range(n):
                            one = b" ".join(words[start + i : start + i + window])
                            rows.append((x["anchor"], x["run"], i, np.uint64(xxh64_intdigest(one)).astype(np.int64).item(), one, x["weight"]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    joined = docs.select("key", "hash", "text").join(wanted, ["key", "hash"]).select("text", "wanted")
    return joined.mapInArrow(take, "anchor long, run long, at int, route long, words binary, weight long")


def matched(pieces: DataFrame, window: int) -> DataFrame:
    """From (route, piece, words, weight): (route, piece, start, n), runs of n windows that come twice or more in a route."""

    def search(rows):
        split = [x.split() for x in rows["words"]]
        ids = {w: i for i, w in enumerate({w for x in split for w in x}, 1)}
        sequences = [np.fromiter(map(ids.__getitem__, x), np.int64, len(x)) for x in split]
        index = FMIndex(sequences, np.array(rows["weight"], np.int64), len(ids), max(map(len, sequences)))
        found = index.repeated(sequences, window)
        i, start, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[c][k] for k in i], pa.int64()) for c in ("route", "piece")] + [pa.array(start, pa.int32()), pa.array(n, pa.int32())],
            ["route", "piece", "start", "n"],
        )

    def shards(batches):
        names = ("route", "piece", "words", "weight")
        held, size = {c: [] for c in names}, 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if size > SHARD_WORDS and row[0] != held["route"][-1]:
                    yield search(held)
                    held, size = {c: [] for c in names}, 0
                for c, x in zip(names, row, strict=True):
                    held[c].append(x)
                size += row[2].count(b" ") + 1
        if size:
            yield search(held)

    return pieces.repartition("route").sortWithinPartitions("route").select("route", "piece", "words", "weight").mapInArrow(shards, "route long, piece long, start int, n int")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key and hash, which tell rows of different ids or texts apart, those without an id too."""
    own = F.col("doc_id").cast("long")
    key = F.coalesce(own, F.xxhash64(F.lit(1), "text")).alias("key")
    return docs.select(own.alias("doc_id"), key, F.xxhash64("text", own.isNull()).alias("hash"), "text")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, hash, spans) from rows with_key(): for every document with repeated windows, structs (start, n) of n windows
    from word start on.

    A passage that very many documents hold is one anchor and one run with very many rows; such keys are broadcast."""
    found = common.written(runs(docs, window, gram), "runs")
    shared = common.written(found.groupBy("anchor").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n_rows")).where("w > 1").select("anchor", "n_rows"), "anchors")
    again = common.written(common.join_each(found.drop("w"), shared, ["anchor"], "n_rows"), "repeated-runs")
    common.removed(found)
    different = common.written(
        again.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("key", "hash", "start", "n")).alias("x")), "different-runs"
    )
    crowded = common.written(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).withColumn("cut", F.col("c") > MOST_RUNS), "crowded")
    witnesses = common.join_each(different, crowded, ["anchor"], "c").select("anchor", "run", "weight", "x.*", "cut")
    pieces = common.written(cut_out(docs, witnesses, window), "pieces")
    whole = pieces.where("at < 0").select("route", F.col("run").alias("piece"), "words", "weight")
    windows = pieces.where("at >= 0").withColumn("piece", F.xxhash64("words"))
    single = windows.groupBy("route", "piece", "words").agg(F.sum("weight").alias("weight"))
    hits = common.written(matched(whole.unionByName(single), window), "hits")
    spans = hits.select(F.col("route").alias("anchor"), F.col("piece").alias("run"), "start", "n")  # those of single windows are of no run
    of_single = windows.select("anchor", "run", "at", "route", "piece").join(hits.select("route", "piece").distinct(), ["route", "piece"])
    spans = spans.unionByName(of_single.select("anchor", "run", F.col("at").alias("start"), F.lit(1).cast("int").alias("n")))
    by_run = spans.distinct().groupBy("anchor", "run").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    by_run = common.written(by_run.join(different.select("anchor", "run", "weight"), ["anchor", "run"]), "spans")
    in_docs = common.join_each(again.select("anchor", "run", "key", "hash", F.col("start").alias("_from")), by_run, ["anchor", "run"], "weight")
    moved = F.transform("found", lambda x: F.struct((F.col("_from") + x["start"]).alias("start"), x["n"].alias("n")))
    return in_docs.select("key", "hash", moved.alias("spans")).groupBy("key", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the kept words joined by a space, for every row."""
    keyed = with_key(docs)
    spans = repeated_windows(keyed, window, gram)

    def drop(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for x in found or []:
                    gone[x["start"]] += 1
                    gone[min(x["start"] + x["n"] + window - 1, len(words))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    joined = keyed.join(spans, ["key", "hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
