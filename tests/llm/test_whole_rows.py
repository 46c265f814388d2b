"""Rows without an id, and rows that repeat one, are rows like the others."""

from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_mixing_stage_takes_rows_without_an_id_and_repeated_ids(spark):
    import corpus_pipeline

    from voxloom.llm import mixing

    rows = [(None if i % 2 else i, f"a{i} " * (i % 7 + 1), "a") for i in range(60)]
    rows += [(None, f"b{i} " * 3, "b") for i in range(40)] + [(1000, f"c{i} " * (1 + i % 5), "c") for i in range(50)]
    df = rows_of(spark, rows)
    got = [Counter(map(tuple, corpus_pipeline.mixing_sources(spark, x, "").collect())) for x in (df, df.repartition(7), df.orderBy("n_chars"))]
    assert got[0] == got[1] == got[2] and set(got[0]) <= set(map(tuple, df.collect())) and max(got[0].values()) <= 2
    targets = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    words = Counter()
    for r, n in got[0].items():
        words[r[3]] += n * len(r[1].split())
    assert set(words) == {"a", "b", "c"}
    assert all(abs(words[s] - targets[s]) <= 7 for s in targets)  # the last document is taken in part


def test_fingerprints_of_rows_without_an_id(spark, tmp_path):
    from voxloom.llm import fingerprint

    texts = ["one text\n\nof two sections", "another", None, ""]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, t, "s") for t in texts]
    rows_of(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op1_fingerprints(spark, f"file://{tmp_path}").collect()
    known = [(r.n_chars, r.fingerprint) for r in got if r.doc_id is not None]
    alone = [(r.n_chars, r.fingerprint) for r in got if r.doc_id is None]
    assert len(got) == 8 and sorted(known) == sorted(alone)
    assert {(r.edited_sha256, r.edited_fingerprint, r.near_edited, r.near_next) for r in got if r.doc_id is None} == {(None,) * 4}
