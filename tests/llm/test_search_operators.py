"""Operators that hold a query set against all rows, by plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD
from voxloom.llm import decontaminate, hard_negatives, lexical_search
from voxloom.llm.fm_index import FMIndex

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, score string"


def words_of(text):
    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in TERM.findall(text or "")]


def some_docs(spark, texts):
    rows = [(None if i % 11 == 5 else i // 2 * 2, t, "x", "x") for i, t in enumerate(texts)]  # null and repeated ids, clashing columns
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, spans string")


def prose(r, n, words=60):
    return " ".join(("W" if r.random() < 0.1 else "w") + str(min(int(r.expovariate(0.08)), words)) + r.choice(["", "", ",", ".é"]) for _ in range(n))


# ranked search


def brute_ranking(docs, items, k):
    counts = [Counter(words_of(r.text)) for r in docs]
    full = [c for c in counts if c]
    n, length = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    out = Counter()
    for item in items:
        scored = []
        for r, c in zip(docs, counts, strict=True):
            m = 50 + (50 * sum(c.values()) * n) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words_of(item.text)) if c[t])
            if score > 0:
                scored.append((-score, r.doc_id is None, r.doc_id or 0, r.doc_id))
        for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[item.item_id, i, d, -s] += 1
    return out


@pytest.mark.parametrize("block_chars,shard", [(10**6, 2_000_000), (150, 40)])
def test_ranking(spark, monkeypatch, block_chars, shard):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", shard)
    r = random.Random(3)
    texts = [*ODD, *[prose(r, r.randrange(1, 90)) for _ in range(150)]]
    docs = some_docs(spark, texts + texts[-40:])
    items = [(i, prose(r, 20), "x", "x") for i in range(6)] + [(1, "w1 w1 W2 none", "x", "x"), (None, "w3", "x", "x"), (8, None, "x", "x"), (9, "", "x", "x"), (10, "w0 漢字 É é \x85", "x", "x")]
    items = spark.createDataFrame(items, ITEMS)
    got = lexical_search.ranked(docs, items, k=7, block_chars=block_chars)
    assert Counter(tuple(x) for x in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_ranking(docs.collect(), items.collect(), 7)


def test_ranking_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a b", "", "")], ITEMS)
    assert lexical_search.ranked(docs([]), items).count() == 0
    assert lexical_search.ranked(docs([None, "", "."]), items).count() == 0
    assert lexical_search.ranked(docs(["a"]), items.limit(0)).count() == 0
    assert lexical_search.ranked(docs(["a"]), items.select("item_id", items.text.substr(1, 0).alias("text"))).columns == ["item_id", "rank", "doc_id", "score"]
    assert [(x.rank, x.doc_id) for x in lexical_search.ranked(docs(["a", "c", "a"]), items).collect()] == [(1, 0), (2, 2)]


def test_treaps_are_in_order_and_heaps():
    r = np.random.default_rng(1)
    term = np.sort(r.integers(0, 12, 3000))
    doc = np.concatenate([np.sort(r.choice(9000, n, replace=False)) for n in np.bincount(term, minlength=12)])
    for impact in (r.integers(1, 40, 3000), np.arange(3000), np.arange(3000)[::-1].copy(), np.ones(3000, np.int64)):
        t = lexical_search.Treaps(term, doc, impact, 14)
        seen = []
        for k in range(14):
            todo = [(int(t.root[k]), -1, 10**9, 10**9)] if t.root[k] != t.none else []
            while todo:
                node, low, high, most = todo.pop()
                assert term[node] == k and low < doc[node] < high and impact[node] <= most
                seen.append(node)
                todo += [(int(c), lo, hi, impact[node]) for c, lo, hi in ((t.left[node], low, doc[node]), (t.right[node], doc[node], high)) if c != t.none]
        assert sorted(seen) == list(range(3000))


def test_search_leaves_out_what_cannot_be_among_the_best(monkeypatch):
    r = np.random.default_rng(2)
    docs, per = 20_000, 8
    term = np.concatenate([r.choice(60, per, replace=False) for _ in range(docs)])
    shard = lexical_search.Shard(list(range(docs)), r.integers(8, 200, docs), np.arange(docs + 1) * per, term, r.integers(1, 5, docs * per), 60, docs, docs * 100)
    seen = []
    scores = shard.scores
    monkeypatch.setattr(shard, "scores", lambda d: (seen.append(len(d)), scores(d))[1])
    weights = np.array([9000, 7000, 300])
    got, score = shard.best(np.array([3, 7, 20]), weights, 50)
    shard.weights[[3, 7, 20]] = weights
    every = scores(np.arange(docs))
    assert sorted(zip(-every, range(docs), strict=True))[:50] == list(zip(-score[:50], got[:50], strict=True))
    assert sum(seen) < docs / 4


# decontamination


def brute_hits(docs, items, window=10):
    phrases = {}
    for item in items:
        w = words_of(item.text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item.item_id)
    for r in docs:
        w, hit, found = words_of(r.text), set(), set()
        for k in {len(p) for p in phrases}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in phrases:
                    hit |= set(range(i, i + k))
                    found |= phrases[tuple(w[i : i + k])]
        yield r.doc_id, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)), " ".join(x for i, x in enumerate(w) if i not in hit)


@pytest.mark.parametrize("block_chars,shard", [(10**6, 500_000), (300, 60)])
def test_decontamination(spark, monkeypatch, block_chars, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    r = random.Random(5)
    items = [prose(r, n) for n in (30, 12, 10, 9, 3, 45)] + ["w1 " * 14, "only", None, "", " .", "É漢 字 a", "é ß"]
    rows = [(i if i != 3 else None, t, "x", "x") for i, t in enumerate(items)] + [(0, prose(r, 14), "x", "x"), (20, items[0], "x", "x")]
    texts = list(ODD)
    for i in range(120):
        w = prose(r, r.randrange(0, 80)).split(" ")
        if i % 2:
            cut = r.choice([x for x in items if x]).split(" ")
            a = r.randrange(len(cut))
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.replace("w", "W") for x in cut[a : a + r.randrange(5, 40)]]
        texts.append("-".join(w) if i % 3 else "\n".join(w))
    texts += ["w1 " * 40, "ONLY only x", texts[-1], texts[-2]]
    docs, asked = some_docs(spark, texts), spark.createDataFrame(rows, ITEMS)
    want = list(brute_hits(docs.collect(), asked.collect()))
    got = decontaminate.contaminated(docs, asked, block_chars=block_chars).collect()
    assert Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in got) == Counter(x[:4] for x in want)
    assert all(a.end <= b.start and a.start < a.end for x in got for a, b in zip(x.spans, x.spans[1:], strict=False))
    assert sum(x[2] > 0 for x in want) > 20
    kept = decontaminate.decontaminated(docs, asked).collect()
    assert Counter((x.doc_id, x.kept) for x in kept) == Counter((x[0], x[4]) for x in want)


def test_decontamination_of_nothing(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, "a b", "", "")], ITEMS)
    assert decontaminate.contaminated(docs([]), items).count() == 0
    for none in (items.limit(0), items.selectExpr("item_id", "CAST(NULL AS string) AS text")):
        assert [(x.n_words, x.n_hit, x.spans, x["items"]) for x in decontaminate.contaminated(docs(["a b", None]), none).orderBy("doc_id").collect()] == [(2, 0, [], []), (0, 0, [], [])]
    docs(["x A-b x", "b a"]).write.parquet(f"{tmp_path}/documents.parquet")
    items.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in decontaminate.op12_decontamination(spark, str(tmp_path)).collect()}
    assert (got[0].n_hit, got[0].n_items, got[0].items_sha256, got[0].contaminated) == (2, 1, hashlib.sha256(b"1").hexdigest(), True)
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256, got[1].contaminated) == (0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_places_of_patterns():
    r = np.random.default_rng(3)
    sequences = [r.integers(1, 4, n) for n in (1, 1, 50, 200, 3, 2)] + [np.ones(90, np.int64)] * 3
    text = np.concatenate([np.append(x, 0) for x in sequences])
    index = FMIndex(sequences, np.ones(len(sequences), np.int64), 3, len(text), sample=32)
    for k in (1, 2, 5):
        patterns = np.unique(r.integers(1, 4, (60, k)), axis=0)
        lane, low, high = index.search(patterns)
        got = {int(i): sorted(index.locate(np.arange(a, b)).tolist()) for i, a, b in zip(lane, low, high, strict=True)}
        want = {i: [p for p in range(len(text) - k + 1) if (text[p : p + k] == x).all()] for i, x in enumerate(patterns)}
        assert got == {i: x for i, x in want.items() if x}


# hard negatives


def brute_negatives(rows, step):
    use = []
    for at, r in enumerate(rows):
        if r.vec_id is None or r.label is None or r.embedding is None or any(x is None or not math.isfinite(x) for x in r.embedding):
            continue
        use.append((at, r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * float(x)) for x in r.embedding]))
    for at, a, label, v in use:
        if a % step:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), b, k, other) for k, b, other, w in use if k != at]
        positives = sorted(x for x in score if x[3] == label)[:5]
        for s, p, *_ in positives:
            fit = sorted(x for x in score if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            yield from ((a, p, i, n, -s, -t) for i, (t, n, *_) in enumerate(fit, 1))


@pytest.mark.parametrize("block,at_once", [(4096, 1 << 21), (3, 200)])
def test_hard_negatives(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(hard_negatives, "AT_ONCE", at_once)
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(300):
        label = r.randrange(4)
        rows.append((i, [0.6 * x + r.gauss(0, 0.4) for x in centres[(label + (r.random() < 0.2)) % 4]], label))
    rows[30] = (30, rows[10][1], rows[10][2])  # an anchor's copy
    rows += [(310, None, 1), (320, [1.0] * 12, None), (None, [1.0] * 12, 1), (330, [1.0, None] * 6, 1), (340, [math.nan] * 12, 1), (350, [math.inf] * 12, 2), (360, [], 1), (371, [9.0, 2.0], 1), (10, rows[10][1], rows[10][2]), (-20, [0.5] * 12, 3)]
    rows += [(400 + i, [1.0] * 12, i % 3) for i in range(40)]  # ties
    df = spark.createDataFrame([(*x, "y", "z") for x in rows], "vec_id long, embedding array<float>, label int, row string, v string")
    got = hard_negatives.mined(df, F.col("vec_id") % 10 == 0, block=block)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = Counter(brute_negatives(df.collect(), 10))
    assert sum(want.values()) > 150
    assert Counter(tuple(x) for x in got.select(columns).collect()) == want


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mined(empty, F.col("vec_id") == 0).count() == 0
    none = spark.createDataFrame([(0, [], 1), (50, [], 1), (1, [], 2)], empty.schema)
    assert hard_negatives.mined(none, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], empty.schema)
    assert hard_negatives.mined(alone, F.col("vec_id") == 0).count() == 0


def test_pairs_that_cannot_matter_are_not_multiplied_out():
    r = np.random.default_rng(6)
    v = np.round(r.normal(size=(400, 64)) * np.linspace(60, 1, 64)).astype(np.int64)
    turn = hard_negatives.rotation(v.astype(float))
    assert np.allclose(turn.T @ turn, np.eye(64))
    a, b = hard_negatives.Rotated(v[:50], turn), hard_negatives.Rotated(v[50:], turn)
    exact = v[:50] @ v[50:].T
    least = np.sort(exact, 1)[:, -5]
    i, j, score = a.pairs(b, np.arange(50), np.arange(350), lambda i, low, high: high >= least[i])
    assert {(x, y) for x, y in zip(*np.nonzero(exact >= least[:, None]), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert (score == exact[i, j]).all() and len(i) < 50 * 350 / 10
