"""Operators that compare documents with each other, against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from compare import same
from conftest_llm import ODD
from voxloom.llm import common, graph, mixing, near_dup, sharding, substring_dedup

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def repeating_texts(seed=7):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = list(ODD)
    for i in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(0, 120))]
        if i % 2:
            at = r.randrange(len(words) + 1)
            cut = r.randrange(0, 26)
            words[at:at] = passage[cut : cut + r.randrange(30, 60)]
        if i % 10 == 3:
            words = words + ["x", "y", "z"] * 30 + words[:40]
        texts.append(" ".join(words))
    return [*texts, texts[-1], texts[-1] + " tail", " ".join(["one"] * 36), " ".join(["two"] * 34), " ".join(["two"] * 34)]


def without_windows(texts, window=35):
    split = [(t or "").encode().split() for t in texts]
    often = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()


@pytest.mark.parametrize("most_runs", [4000, 0])
def test_substring_dedup(spark, docs, monkeypatch, most_runs):
    monkeypatch.setattr(substring_dedup, "MOST_RUNS", most_runs)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    texts = repeating_texts()
    got = by_id(substring_dedup.without_repeats(docs(texts, extra=True)))
    assert [(got[i].n_words, got[i].n_removed, got[i].kept) for i in range(len(texts))] == list(without_windows(texts))


def test_substring_dedup_of_nothing_and_without_ids(spark, docs):
    assert substring_dedup.without_repeats(docs([])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")
    got = by_id(substring_dedup.without_repeats(df))
    assert got[1].n_removed == got[None].n_removed == 40  # rows without an id are documents like the others


def test_substring_dedup_of_shared_ids(spark, monkeypatch):
    """Rows are told apart by id and text; one without id and text may lie beside an id that equals its hash."""
    monkeypatch.setattr(common, "LEAST_HOT", 1)
    a, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "acd")
    rows = [(1, a), (2, a), (1, c), (None, a + " " + d), (None, None), (None, d), (42, "start " + d), (7, c + " end"), (7, "x " + c), (7, "x " + c)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(df).collect())
    want = [(i or 0, *found) for (i, _), found in zip(rows, without_windows([t for _, t in rows]), strict=True)]
    assert got == sorted(want)


def sets_of(texts, k):
    for t in texts:
        w = (t or "").encode().lower().split()
        yield frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def true_components(texts, k, percent=80):
    sets, parent = list(sets_of(texts, k)), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts(seed=11):
    r = random.Random(seed)
    texts = list(ODD)
    for _ in range(4):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 90))]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randrange(0, 8)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return [*texts, "A b C", "a B c", "a", "A"]


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(common, "LEAST_HOT", block)
    texts = near_texts()
    sizes, want = true_components(texts, 2)
    got = by_id(near_dup.near_duplicates(docs(texts, extra=True), k=2))
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_nothing_and_without_ids(spark, docs):
    assert near_dup.near_duplicates(docs([])).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (5, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(df, k=2).collect())
    assert got == [(0, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]


def test_near_duplicates_of_shared_ids(spark):
    """Different texts of one id are documents by themselves, linked or not."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, words), (1, ["other", *words[30:]]), (2, words[:-1]), (2, ["no", "links"]), (3, ["other", *words[30:], "end"]), (4, ["no", "links"])]
    df = spark.createDataFrame([(i, " ".join(w), n) for n, (i, w) in enumerate(rows)], "doc_id long, text string, row int")
    got = {r.row: r for r in near_dup.near_duplicates(df, k=2, also=("row",)).collect()}
    assert [got[i].component_id for i in range(6)] == [1, 1, 1, 2, 1, 2]
    assert got[0].component == got[2].component != got[1].component == got[4].component


@pytest.mark.parametrize("shared", [120, 150])
def test_texts_of_one_template_are_not_paired_with_each_other(spark, shared):
    """Pairs grow with the texts, not with their square, where all share most words but none is a near copy."""
    found = []
    for n in (500, 1000, 2000):
        texts = [(i, 0, " ".join([f"t{k}" for k in range(shared)] + [f"own{i}-{k}" for k in range(45)])) for i in range(n)]
        df = spark.createDataFrame([(i, i, t) for i, _, t in texts], "id long, component long, text string")
        found.append(near_dup.close_pairs(df.select("id", "component"), near_dup.orders(df, 2, 80), 80).count())
    assert all(b <= 2.5 * max(a, 1) for a, b in zip(found, found[1:]))
    got = near_dup.near_duplicates(df.select(df.id.alias("doc_id"), "text"), k=2).collect()
    assert all(r.kept for r in got)


def test_estimates_are_close():
    import numpy as np

    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        a = r.integers(0, 2**63, 1000).astype(np.uint64)
        b = a.copy()
        n = int(1000 * (1 - share) / (1 + share))
        b[:n] = r.integers(0, 2**63, n)
        x, y = near_dup.registers([np.unique(a), np.unique(b)])
        assert abs(near_dup.estimate(x[None], y[None], np.array([1000]), np.array([1000]))[0] - share) < 0.16


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(graph.components(edges).collect())
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_mixing_against_sql(spark):
    same(mixing.op10_mixing(spark, SF), mixing.ORACLE_SQL, SF)


def test_mixing_meets_its_targets(spark, docs):
    r = random.Random(3)
    texts = [*ODD, *["w " * r.randrange(1, 50) for _ in range(300)]]
    sources = [("hot", "b", "c", None)[0 if i % 3 else 1 + i % 9 // 3] for i in range(len(texts))]
    df = docs(texts, sources, extra=True)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts) and sum(x.size for x in rows) == sum(len((t or "").encode().split()) for t in texts)
    by_source = {}
    for x in rows:
        assert 0 <= x.taken <= 2 * x.size and (x.position is None) == (x.taken == 0)
        by_source.setdefault(x.source, []).append(x)
    for own in by_source.values():
        assert abs(sum(x.taken for x in own) - own[0].target) <= 0.5
        assert own[0].source_size == sum(x.size for x in own)
    assert abs(sum(own[0].target for own in by_source.values()) - 1.5 * sum(x.size for x in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    positions = [x.position for x in rows if x.position is not None]
    assert positions == sorted(positions)
    assert mixing.mix(docs([])).count() == 0 and {x.taken for x in mixing.mix(docs([None, ""])).collect()} == {0}


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F

    for start, end in ((1.0, 3.0), (1.0, 1.0), (3.0, 1.0), (0.0, 1.0)):
        df = spark.range(1, 101).withColumn("t", mixing.due(F.col("id") / 100, F.lit(start), F.lit(end)))
        for x in df.collect():
            assert abs((start * x.t + (end - start) * x.t**2 / 2) / ((start + end) / 2) - x.id / 100) < 1e-9


def test_sharding_round_trip(spark, docs, tmp_path):
    texts = [*ODD, *[f"text {i}" for i in range(200)]]
    df = docs(texts, extra=True)
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
    for i in range(5):
        table.append(df.where(df.doc_id % 5 == i).repartition(3), f"a{i}")
    before, version = table.manifest().count(), table.version()
    assert version == 5 and before == 15
    assert table.settle(target=100_000, fan_in=2) > version
    assert table.manifest().count() < before
    for v in (version, None):
        assert Counter(map(tuple, table.read(v).drop("_shard").collect())) == Counter(map(tuple, df.collect()))
    table.vacuum()
    assert table.read().count() == len(texts)
    with pytest.raises(sharding.Conflict):
        table._commit(table.manifest(), table.version() - 1)
    table.append(df.limit(0), "empty")
    assert table.read().count() == len(texts)


def test_sharding_of_nothing(spark, docs, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        table.read()
    table.append(docs([]), "empty")
    assert table.settle() == 1
    table.vacuum()
    assert table.read().count() == 0 and table.read().drop("_shard").columns == docs([]).columns


def test_two_writers_of_one_version(spark, docs, tmp_path, monkeypatch):
    """Both have found the version free and staged their lists before either puts its own in place."""
    from threading import Barrier, Thread

    ready, put, got = Barrier(2, timeout=120), sharding.ShardedTable._put, []

    def together(self, *paths):
        ready.wait()
        return put(self, *paths)

    def write(i):
        table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
        try:
            got.append((i, table._commit(lists[i], 0)))
        except sharding.Conflict:
            got.append((i, None))

    lists = [spark.createDataFrame([(f"run/{i}", "a", 1, 1)], sharding.MANIFEST) for i in range(2)]
    monkeypatch.setattr(sharding.ShardedTable, "_put", together)
    writers = [Thread(target=write, args=(i,)) for i in range(2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    monkeypatch.undo()
    assert sorted(str(v) for _, v in got) == ["1", "None"]
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
    assert table.version() == 1 and [r.shard for r in table.manifest().collect()] == [f"run/{next(i for i, v in got if v)}"]


def test_a_rename_in_other_stores_never_replaces(spark, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t")
    real, asked = table._path, []

    class Elsewhere:
        def toUri(self):
            return self

        def getScheme(self):
            return "elsewhere"

    def path(x):
        asked.append(x)
        return Elsewhere() if len(asked) == 1 else real(x)

    for name, want in (("a", True), ("b", False)):
        (tmp_path / name).write_text(name)
        table._path = path
        asked.clear()
        assert table._put(f"file://{tmp_path}/{name}", f"file://{tmp_path}/place") is want
    assert (tmp_path / "place").read_text() == "a" and (tmp_path / "b").exists()


def test_an_append_goes_on_top_of_the_version_that_won(spark, docs, tmp_path, monkeypatch):
    one, other = (sharding.ShardedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    shards, seen = one._shards, []

    def meanwhile(*a):
        if not seen:
            seen.append(other.append(docs(["from the other"]), "b"))
        return shards(*a)

    monkeypatch.setattr(one, "_shards", meanwhile)
    assert one.append(docs(["own"]), "a") == 2 and seen == [1]
    assert sorted(r.text for r in one.read().collect()) == ["from the other", "own"]


def test_sharding_against_sql(spark):
    same(sharding.op4_sharding(spark, SF), sharding.ORACLE_SQL, SF)


def test_every_query_bears_odd_and_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from voxloom.llm import registry

    odd = docs([*ODD, "same text here " * 50, "same text here " * 50]).withColumn("lang", F.lit(None).cast("string")).withColumn("kept", F.lit("clash")).withColumn("size", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for name, n in (("odd", odd.count()), ("none", 0)):
        folder = f"file://{tmp_path}/{name}"
        (odd if n else odd.limit(0)).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        (labels if n else labels.limit(0)).coalesce(1).write.parquet(f"{folder}/labels.parquet")
        for query, run in registry.QUERIES.items():
            if query.startswith(("op11", "op12", "op13")):
                continue  # they have other tables; see test_search_operators
            assert run(spark, folder).count() == n, query
        assert corpus_pipeline.run(spark, folder).count() <= 2 * n


def test_pipeline_keeps_rows_of_shared_and_missing_ids(spark, tmp_path):
    import corpus_pipeline as p

    say = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " end"), (None, say("c")), (None, say("d")), (3, say("e")), (3, say("e")), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.minhash_near_dedup(spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for k, (i, t) in enumerate(rows) if k not in (2, 6))
    mixed = p.mixing_sources(spark, got, "")
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(i, t) for i, t in rows if t}
    assert {r.doc_id for r in mixed.collect()} == {None, 1, 3} and p.bpe_encoding(spark, mixed, "").count() == mixed.count()


def test_sharding_query_keeps_every_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = by_id(sharding.op4_sharding(spark, SF))
    assert {i: r.text_sha256 for i, r in got.items()} == {d.doc_id: hashlib.sha256(d.text.encode()).hexdigest() for d in docs}


def test_pipeline_leaves_no_table_of_a_finished_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    got = p.run(spark, SF)
    assert [x.name.rsplit("-", 1)[0] for x in (tmp_path / "voxloom").iterdir()] == ["stage-3"] and got.count() > 0


def test_tables_are_cleared_by_the_thread_that_wrote_them(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2)

    def work(i):
        with common.cleared(spark):
            df = common.written(spark.range(i), "mine")
            assert df.count() == i
            both.wait()
        both.wait()

    def late(i):
        with common.cleared(spark):
            df = common.written(spark.range(i), "mine")
            both.wait()
            both.wait()  # the other's tables are gone by now
            return df.count()

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(work, 3), pool.submit(late, 7)
        assert (a.result(), b.result()) == (None, 7)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    from voxloom.llm import common, quality, secrets

    docs = common.documents(spark, SF)
    kept = p.quality_rules(spark, docs, SF)
    assert kept.columns == list(p.COLUMNS)
    verdict = {r.doc_id: r.kept for r in quality.op7_quality_rules(spark, SF).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in verdict.items() if k}
    single = common.written(p.minhash_near_dedup(spark, kept, SF), "test")
    texts = {r.doc_id: r.text for r in kept.collect()}
    ids = sorted(texts)
    want = true_components([texts[i] for i in ids], 5)[1]
    assert {r.doc_id for r in single.collect()} == {ids[i] for i, c in enumerate(want) if c == i}
    clean = common.written(p.secret_scans(spark, single, SF), "test")
    assert clean.count() == single.count() and {len(r.text) == r.n_chars for r in clean.collect()} == {True}
    assert not any(len(x.found) for x in secrets.find(clean, secrets.vocabulary()).collect())
    mixed = common.written(p.mixing_sources(spark, clean, SF), "test")
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in clean.collect()} and max(times.values()) <= 2
    encoded = p.bpe_encoding(spark, mixed, SF)
    assert Counter(r.doc_id for r in encoded.collect()) == times
    wanted = [(at, r.doc_id) for r in mixing.mix(clean, also=("n_chars",)).where("taken > 0").collect() for at in r.positions[: int(r.taken / r.size + 0.5)]]
    in_order = [r.doc_id for r in encoded.orderBy("training_order").collect()]
    assert in_order == [i for _, i in sorted(wanted)]  # the curriculum, from the last stage's rows
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
