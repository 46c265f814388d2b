"""Operators that look at one document at a time, against plain Python."""

import hashlib
import random
import re
from collections import Counter

from conftest_llm import ODD
from voxloom.llm import bpe, fingerprint, licenses, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_base_counts(spark, docs):
    random.seed(3)
    texts = [*ODD, *[" ".join(random.choice("abc") for _ in range(n)) for n in (4, 5, 9, 40, 200)], "l\nl\nm\n \nl"]
    for i, r in by_id(quality.base_counts(docs(texts, extra=True))).items():
        text = texts[i] or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality_weights_and_verdict(spark, docs):
    import numpy as np

    texts = [f"plain words of kind {i} that go on for a while here" for i in range(40)] + [f"junk### {i}$$$ of%%% kind&&& {i} that*** is### not### plain### at### all###" for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id long, quality int")
    w = quality.weights(docs(texts), labels, buckets=4096)
    judged = by_id(quality.with_score(quality.base_counts(docs(texts)), w))
    assert min(judged[i].score for i in range(40)) > max(judged[i].score for i in range(40, 80))
    assert quality.judge(docs([]), labels).count() == 0
    assert not np.any(quality.weights(docs(texts), labels.limit(0), buckets=64))


def test_quality_score_and_verdict_by_brute_force(spark):
    """Counts, weights, scores and verdicts of the query again in plain Python."""
    import math

    from xxhash import xxh64

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashed = lambda *words: __import__("functools").reduce(lambda seed, w: xxh64(w.encode(), seed=seed).intdigest(), words, 42)
    bucket = lambda *words: signed(hashed(*words)) % quality.BUCKETS
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(trusted) <= quality.TRUSTED
    raw, target, of = Counter(), Counter(), {}
    for d in docs:
        w = WORD.findall(d["text"] or "")
        of[d["doc_id"]] = [bucket(x) for x in w] + [bucket(x, y) for x, y in zip(w, w[1:])]
        raw.update(of[d["doc_id"]])
        if d["doc_id"] in trusted:
            target.update(of[d["doc_id"]])
    pseudo, n, m = quality.SMOOTHING * quality.BUCKETS, sum(raw.values()), sum(target.values())
    weight = {b: math.log((target[b] + pseudo * c / n) / (m + pseudo) / (c / n)) for b, c in raw.items()}
    got = by_id(quality.op7_quality_rules(spark, SF))
    assert len(got) == len(docs)
    for i, f in of.items():
        score = sum(weight[b] for b in f) / len(f) if f else 0.0
        assert abs(got[i].score - score) < 1e-9
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.THRESHOLD)


def base_spans(text):
    found = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_secret_spans(spark, docs):
    key = "aZ3kQ9xT7LmP2vR8cN4wY6bH1dF5"
    texts = [*ODD, "api_key: 'abcdef123' é token = short TOKEN=\"deadbeefdeadbeefdeadbeef\"", "secret=token = abcdef123", "AKIA" + "A1" * 8, "AKIAshort", "f" * 24, f"see {key} here", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "internationalization_of_everything"]
    found = by_id(secrets.find(docs(texts, extra=True), secrets.vocabulary()))
    for i, text in enumerate(texts):
        assert [(x.start, x.kind, x.end) for x in found[i].found if x.kind != "random"] == base_spans(text or "")
    assert [(x.kind, texts[16][x.start : x.end]) for x in found[16].found] == [("random", key)]
    assert not found[18].found and not found[19].found
    cleaned = by_id(secrets.redacted(docs(texts), secrets.vocabulary()))
    assert cleaned[16].text == "see [random] here" and cleaned[16].n_chars == len("see [random] here") and cleaned[0].text is None


def test_recall_of_random_keys_by_kind_and_length():
    import string

    tokens_of, r = secrets.tiktoken_encoder(secrets.vocabulary()), random.Random(8)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for kind in (low + up + digits, low + up + digits + "+/", low + up, low + digits, up + digits, low, up, digits + "ABCDEF"):
        for n in (16, 20, 24, 32, 40, 64):
            keys = ["".join(r.choices(kind, k=n)) for _ in range(300)]
            hit = sum(any(k == "random" for *_, k in secrets.scan(f"it is {x}, or so", tokens_of)) for x in keys)
            assert hit >= 0.9 * len(keys), (kind, n, hit)


def test_what_is_no_random_key():
    tokens_of = secrets.tiktoken_encoder(secrets.vocabulary())
    digest = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    words = ["Donaudampfschifffahrt", "internationalization_of_everything", "getNumberOfRowsInTable", "src/main/java/package", "HAVE_SYS_XATTR_H", "2024-05-06_12-30-59", "=" * 40, "123E4567-E89B-12D3-A456-426614174000", f"SHA1: {digest}"]
    assert not any(secrets.scan(f"see {w} here", tokens_of) for w in words)
    assert [x[2] for x in secrets.scan(f"see {digest} here", tokens_of)] == ["random"]
    texts = [r[0] for r in __import__("duckdb").sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    assert sum(k == "random" for t in texts for *_, k in secrets.scan(t, tokens_of)) <= 1  # none is planted there


def test_fingerprints(spark, docs):
    texts = [*ODD, "one line. " * 20, "one line. " * 20 + "more", "section one.\nline two of it.\n\nsection two.\nits line.\n"]
    df = docs(texts, extra=True)
    trees = fingerprint.with_tree(df, "text", "tree").withColumn("fp", fingerprint.fingerprint("tree"))
    fps = {r.doc_id: r.fp for r in trees.collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (fps[i] == fps[j]) == ((a or "") == (b or ""))
    last = len(texts) - 1
    pieces = trees.where(f"doc_id = {last}").select("tree").first()[0]
    assert [len(s.paragraphs) for s in pieces.sections] == [3, 2]


def test_likeness_and_differing_paragraphs(spark):
    a = "first line here.\nsecond line here.\n\nthird one, unchanged.\nfourth line.\n"
    b = a.replace("second", "altered")
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, "", ""), (4, "", a)], "doc_id long, x string, y string")
    both = fingerprint.with_tree(fingerprint.with_tree(df, "x", "tx"), "y", "ty")
    both = both.withColumn("fx", fingerprint.fingerprint("tx")).withColumn("fy", fingerprint.fingerprint("ty"))
    near = {r.doc_id: r.near for r in fingerprint.with_likeness(both, "fx", "fy", "near").collect()}
    assert near[2] == near[3] == 1 and near[4] == 0 and 0.5 < near[1] < 1
    rows = fingerprint.differing_paragraphs(both.select("doc_id", "tx", "ty").where("doc_id < 3"), "tx", "ty").collect()
    assert [(r.doc_id, a[r.start : r.start + r.n_chars]) for r in rows] == [(1, "second line here.\n")]


def tree_of(text):
    """[[(paragraph, pieces)]] of the sections of a text, in plain Python."""
    import regex

    cut = lambda x, end: [p for p in regex.split(end, x, flags=regex.V1) if p]
    out = []
    for i, section in enumerate(cut(text, r"(?<=\n\n)")):
        out.append([])
        for j, p in enumerate(cut(section, r"(?<=\n)")):
            head = p[: fingerprint.FINE_CHARS] if i + j == 0 else ""
            out[-1].append((p, regex.findall(fingerprint.FINE, head) + regex.findall(fingerprint.PIECE, p[len(head) :])))
    return out


def likeness_of(a, b):
    x, y = ({hashlib.sha256(q.encode()).hexdigest()[:6] for s in tree_of(t) for _, ps in s for q in ps} for t in (a, b))
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def first_difference(a, b):
    x, y = tree_of(a), tree_of(b)
    for i, s in enumerate(x):
        if i >= len(y) or s != y[i]:
            for j, p in enumerate(s):
                if i >= len(y) or j >= len(y[i]) or p != y[i][j]:
                    return i, j, sum(len(q) for t in x[:i] for q, _ in t) + sum(len(q) for q, _ in s[:j])
            return i, None, None
    return None, None, None


def test_fingerprint_query(spark, tmp_path):
    from voxloom.llm.fingerprint import op1_fingerprints

    given = spark.read.parquet(f"{SF}/documents.parquet")
    short = ["Short one.", "word", "four words of text", "a\n\nb\n", "", "Ein kurzer Satz, mehr nicht", "p\nq\n\nr\ns\n"]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(short)], "doc_id long, text string, lang string, source string, n_chars long")
    given.unionByName(more.select(*[more[c].cast(given.schema[c].dataType).alias(c) for c in given.columns])).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").orderBy("doc_id").collect()
    got, texts = by_id(op1_fingerprints(spark, f"file://{tmp_path}")), [r.text or "" for r in rows]
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        t, after, x = texts[i], texts[(i + 1) % len(texts)], got[r.doc_id]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (x.fingerprint == x.edited_fingerprint) == (t == edited)
        assert abs(x.near_edited - likeness_of(t, edited)) < 1e-12 and abs(x.near_next - likeness_of(t, after)) < 1e-12
        assert (x.edited_section, x.edited_paragraph, x.edited_start) == first_difference(t, edited)
    assert min(got[1000 + i].near_edited for i in (0, 2, 5)) > 0.3 and got[1004].near_edited == 1.0


def test_next_ids_over_sparse_ids(spark):
    ids = sorted({random.Random(5).randrange(-(2**62), 2**62) for _ in range(200)} | {0, 1, 2, 5000})
    got = dict(fingerprint.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect())
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_bpe_against_the_tokenizers_library(spark, docs):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.vocabulary())
    theirs.no_truncation()
    theirs.no_padding()
    random.seed(1)
    alphabets = ["abcdefghij", "aaaab", "the in re er on ", "éàßüñ ÀÉΣσ ς İ", "0123456789", "'s 're 'LL don't", "​　\x1c\x85\xa0 é\U0001f600漢字 ﬁ<|endoftext|>", "!?#%&*"]
    texts = [*ODD, *["".join(random.choice(random.choice(alphabets)) for _ in range(random.randint(0, 60))) for _ in range(800)], "a" * 700, "<|endoftext|><|startoftext|> hi"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = by_id(bpe.encode_and_decode(docs(texts, extra=True), bpe.vocabulary(), with_ids=True))
    for i, text in enumerate(texts):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_patience_against_a_common_subsequence():
    random.seed(2)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([random.choice("abcdefghijklmnop") for _ in range(random.randint(0, 15))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= common(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def recursive_patience(a, b):
    """All alignments that direct recursion may give, one for each choice among equally long chains of anchors."""
    from itertools import combinations, product

    if not a or not b:
        return {()}
    if a[0] == b[0]:
        return {((0, 0), *((i + 1, k + 1) for i, k in x)) for x in recursive_patience(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {(*x, (len(a) - 1, len(b) - 1)) for x in recursive_patience(a[:-1], b[:-1])}
    once = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    for n in range(len(once), 0, -1):
        chains = [c for c in combinations(once, n) if [b.index(w) for w in c] == sorted(b.index(w) for w in c)]
        if chains:
            break
    else:
        return {()}
    out = set()
    for chain in chains:
        ends = [(-1, -1), *[(a.index(w), b.index(w)) for w in chain], (len(a), len(b))]
        gaps = [[tuple((p + 1 + i, q + 1 + k) for i, k in x) for x in recursive_patience(a[p + 1 : r], b[q + 1 : s])] for (p, q), (r, s) in zip(ends, ends[1:])]
        out |= {tuple(sorted([*ends[1:-1], *(pair for part in parts for pair in part)])) for parts in product(*gaps)}
    return out


def test_patience_against_recursion():
    random.seed(12)
    for _ in range(400):
        a, b = ([random.choice("abcdefghijkl") for _ in range(random.randint(0, 10))] for _ in range(2))
        assert tuple(licenses.patience(a, b)) in recursive_patience(a, b)


def test_every_template_is_found_with_words_changed_left_out_and_put_in():
    scanner, r = licenses.Scanner(), random.Random(13)
    for name, (text, names) in licenses.TEMPLATES.items():
        words = text.split()
        if len(words) < 25:
            assert [x[2] for x in scanner.scan(f"some words before. {text} And after.")] == [name]
            continue
        for _ in range(5):
            edited = list(words)
            for _ in range(len(words) // 12):
                k = r.randrange(len(edited))
                edited[k : k + 1] = r.choice([[], ["changed"], [edited[k], "added"]])
            found = scanner.scan("x " * r.randrange(200) + " ".join(edited) + " y" * r.randrange(200))
            near = {"ISC": {"ISC", "ISC-text"}, "GPL-3.0-notice": {"GPL-3.0-notice", "GPL-2.0-notice", "AGPL-3.0-notice"}, "AGPL-3.0-notice": {"GPL-3.0-notice", "AGPL-3.0-notice"}}.get(name, {name})
            assert len(found) == 1 and found[0][2] in near, (name, [x[2] for x in found])
    twice = licenses.TEMPLATES["ISC"][0]
    assert [x[2] for x in scanner.scan(f"{twice} {twice}")] == ["ISC", "ISC"]
    assert not scanner.scan(" ".join(sorted(licenses.TEMPLATES["MIT-text"][0].split())))


def test_no_window_is_missed():
    r = random.Random(14)
    for _ in range(300):
        words, template = [r.choice("abcdef") for _ in range(r.randrange(40))], Counter(r.choices("abcd", k=6))
        got = licenses.windows(words, template, 8, 5)
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 8) + 1):
                if sum((Counter(words[i:j]) & template).values()) >= 5:
                    assert any(a <= i and j <= b for a, b in got)


def test_license_spans(spark, docs):
    mit = licenses.TEMPLATES["MIT-text"][0]
    texts = [*ODD, "Some words. Released under the MIT License. More words.", "before " + mit.replace("charge", "cost") + " after", "MIT is a university. The license is not here.", "x " * 300 + licenses.TEMPLATES["Apache-2.0-notice"][0]]
    got = {r.doc_id: [(x.license, texts[r.doc_id][x.start : x.end]) for x in r.found] for r in licenses.find(docs(texts, extra=True)).collect()}
    n = len(ODD)
    assert all(not got[i] for i in range(n)) and not got[n + 2]
    assert got[n] == [("MIT", "Released under the MIT License")]
    assert [x for x, _ in got[n + 1]] == ["MIT-text"] and [x for x, _ in got[n + 3]] == ["Apache-2.0-notice"]


def counted(text: str) -> Counter:
    row, bucket = toxicity.features([text])
    assert (row == 0).all()
    return Counter(bucket.tolist())


def test_toxicity_features_are_words_their_starts_pairs_and_skips():
    """Features of small texts, told apart by what is left of them, make up those of any text."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(40)] + ["straße", "naïve", "日本語の文章", "x1"]
    alone = {w: counted(w) for w in vocabulary}
    assert all(sum(c.values()) == 3 for c in alone.values())  # the word, four characters, five characters
    assert counted("abcdx") & counted("abcdy") == Counter([b for b in counted("abcdx") if b in counted("abcdz")])
    assert sum((counted("abcdexx") & counted("abcdeyy")).values()) == 2 and sum((counted("abcdx") & counted("abcdy")).values()) == 1

    def pair(gap: int, x: str, y: str, filler: str = "ff") -> int:
        """The bucket of x with y, gap - 1 words between them: what other features don't account for."""
        between = [f"{filler}{k}" for k in range(gap - 1)]
        words = [x, *between, y]
        left = counted(" ".join(words))
        for w in words:
            left -= counted(w)
        for g in range(1, gap):
            for i in range(len(words) - g):
                left -= Counter([pair(g, words[i], words[i + g])])
        (bucket, times), = left.items()
        assert times == 1
        return bucket

    for _ in range(20):
        x, y = r.sample(vocabulary, 2)
        found = [pair(g, a, b) for g in (1, 2, 3) for a, b in ((x, y), (y, x))]
        assert len(set(found)) == 6 and pair(3, x, y, "other") == found[4]
    for n in (0, 1, 2, 3, 4, 30):
        words = [r.choice(vocabulary) for _ in range(n)]
        want = Counter()
        for w in words:
            want += alone[w]
        for g in (1, 2, 3):
            want += Counter(pair(g, x, y) for x, y in zip(words, words[g:]))
        assert counted("  ".join(w.upper() if w.isascii() else w for w in words) + "!?") == want
    texts = [" ".join(r.choices(vocabulary, k=k)) for k in (5, 0, 1, 7)] + [None, "", "... --"]
    row, bucket = toxicity.features(texts)
    for i, t in enumerate(texts):  # no feature reaches from one text into the next
        assert Counter(bucket[row == i].tolist()) == (counted(t) if t else Counter())
    assert len({b for i in range(20_000) for b in (int(toxicity.features([f"{i}"])[1][0]),)}) > 19_700  # 20,000 words in 2^20 buckets


def test_toxicity_on_held_out_rows(spark, docs):
    random.seed(4)
    plain, bad = [f"word{i}" for i in range(200)], ["idiot", "scum", "clown", "trash"]
    texts, toxic = [], []
    for i in range(1500):
        words = random.choices(plain, k=40)
        if i % 5 == 0:
            for _ in range(4):
                words[random.randrange(40)] = random.choice(bad)
        texts.append(" ".join(words))
        toxic.append(int(i % 5 == 0))
    df = docs([*texts, *ODD], extra=True)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = by_id(toxicity.judge(df, toxicity.fit(df, labels)))
    rest = [r.doc_id for r in df.where(toxicity.held_out(df.doc_id)).select("doc_id").collect() if r.doc_id < 1500]
    assert len(rest) > 300
    assert sum(got[i].predicted == toxic[i] for i in rest) >= 0.97 * len(rest)
    assert all(got[1500 + k].predicted == 0 for k in range(len(ODD)))
    none = by_id(toxicity.judge(df, toxicity.fit(df, labels.limit(0))))
    assert {r.score for r in none.values()} == {0.5}


def test_ftrl_by_brute_force():
    """The same updates one coordinate at a time, from the definition, and the same scores."""
    import math

    import numpy as np

    r = random.Random(15)
    texts = [" ".join(r.choice(["red", "green", "blue", "you", "fool", "sky"]) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    labels = [int("fool" in t.split()) for t in texts]
    rows = [(np.unique(toxicity.features([t])[1]), y) for t, y in zip(texts, labels)]
    alpha, beta, l1, l2, times = 0.3, 1.0, 0.8, 0.1, 3.0
    z, n = Counter(), Counter()

    def weight(i):
        pull = 0.0 if i == toxicity.BIAS else l1
        return 0.0 if abs(z[i]) <= pull else -(z[i] - math.copysign(pull, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(4):
        for found, y in rows:
            own = [*found.tolist(), toxicity.BIAS]
            w = {i: weight(i) for i in own}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (times if y else 1)
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in n if weight(i)}
    i, w = toxicity.train(rows, 4, alpha, beta, l1, l2, times)
    assert dict(zip(i.tolist(), w.tolist())).keys() == want.keys() and all(abs(want[k] - v) < 1e-9 for k, v in zip(i.tolist(), w.tolist()))
    assert 0 < len(want) < len(n)  # L1 leaves coordinates at zero
    dense = np.zeros(toxicity.BIAS + 1)
    dense[i] = w
    for t, score in zip([*texts, ""], toxicity.scores([*texts, ""], dense)):
        total = sum(want.get(k, 0.0) for k in {*toxicity.features([t])[1].tolist(), toxicity.BIAS})
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
