"""Exact byte-pair encoding and decoding with a given vocabulary.

Encoding a word: an Aho-Corasick automaton gives the longest tokens from left to right, and if these may not stand next to
each other, all tokens that start at each position. Then, from the left, the longest one is taken that may stand next to
the token before; where none may, the last token is taken back and its next shorter alternative tried. Positions at which no continuation exists are remembered, so the work is linear in the word. Two
tokens may stand next to each other if merging their joined text would give just these two; that needs only the merges
along the facing edges of both tokens and is kept in a table as pairs come up. Decoding cuts tokens out of one string of
all tokens by an offset table.

Null texts count as empty and have no tokens. Rows are encoded by themselves, so repeated rows and ids give repeated
results, further columns have no influence, and an empty table gives no rows; there are no ties, as merges are exact.
Memory in a task is bounded by the vocabulary, the word table (emptied at a fixed size) and one piece of text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import common

#: Words whose tokens a task remembers; the table is emptied when full.
MOST_WORDS = 300_000
END = "\n"  # stands for the end of a word within the automaton; byte symbols never are line breaks


def byte_symbols() -> list[str]:
    """The printable character for each byte: printable Latin-1 ones are themselves, others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Everything below is assigned.
BEYOND = re.compile("[\u0378-\U0010ffff]")


def is_newer(text: str) -> bool:
    """Whether a text has characters that Python's Unicode tables don't know."""
    return BEYOND.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))


class Tokenizer:
    """Reads a tokenizers JSON file whose model is BPE with an end-of-word suffix over byte symbols."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.to_symbols = dict(enumerate(byte_symbols()))
        self.path = path
        vocab: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: the rank of the merge that makes it, left, right
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = r
            self.parts.setdefault(vocab[a + b], (r, left, right))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            as_key = token[: -len(self.suffix)] + END if token.endswith(self.suffix) and token != self.suffix else token
            if as_key != END:
                self.automaton.add_word(as_key, (len(as_key), i))
        self.automaton.make_automaton()
        self.edges: dict[int, dict[int, list[tuple[int, float]]]] = {1: {}, 2: {}}
        self.compatible: dict[tuple[int, int], bool] = {}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        stored = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.offsets = [0, *accumulate(map(len, stored))]
        self.stored = b"".join(stored)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge (1: left, 2: right) as the token grows, each with the rank of the merge that uses it up."""
        known = self.edges[side]
        if token not in known:
            found, at, until = [(token, float("inf"))], token, self.parts.get(token)
            while until:
                at = until[side]
                found.append((at, until[0]))
                until = self.parts.get(at)
            known[token] = found
        return known[token]

    def may_meet(self, left: int, right: int) -> bool:
        """Whether no merge across the seam would come before the ones that make the two tokens.

        Of equal merges the leftmost comes first: across the seam before one in `right`, after one in `left`."""
        got = self.compatible.get((left, right))
        if got is None:
            starts = self.edge(right, 1)
            got = not any(
                (r := self.rank.get((a, b))) is not None and r < used_a and r <= used_b
                for a, used_a in self.edge(left, 2)
                for b, used_b in starts
            )
            if len(self.compatible) >= 4 * MOST_WORDS:
                self.compatible.clear()
            self.compatible[left, right] = got
        return got

    def encode_word(self, word: str) -> list[int]:
        text = word.encode().decode("latin-1").translate(self.to_symbols) + END
        n, met = len(text), self.compatible
        longest = [x for _, x in self.automaton.iter_long(text)]
        if sum([length for length, _ in longest]) == n:  # these are right unless two of them may not meet
            greedy = [token for _, token in longest]
            if all([met[p] if p in met else self.may_meet(*p) for p in zip(greedy, greedy[1:])]):
                return greedy
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(text):
            starting[end - length + 1].append((length, token))  # shorter ones come first
        taken: list[tuple[int, int]] = []  # token and where it starts
        left = [None] * n  # alternatives not yet tried at a position on the path
        dead: set[tuple[int, int]] = set()  # (token, end) from which the rest can't be encoded
        at = 0
        left[0] = list(starting[0])
        while at < n:
            before = taken[-1][0] if taken else None
            while left[at]:
                length, token = left[at].pop()
                if (token, at + length) not in dead and (before is None or self.may_meet(before, token)):
                    taken.append((token, at))
                    at += length
                    if at < n:
                        left[at] = list(starting[at])
                    break
            else:
                if not taken:
                    raise ValueError(f"no tokens for {word!r}")
                token, start = taken.pop()
                dead.add((token, at))
                at = start
        return [token for token, _ in taken]

    def words(self, text: str) -> list[str | int]:
        """The words to encode, normalised, and the ids of special tokens that the text spells out.

        White space is in no word, so it makes no difference that the normaliser joins runs of it."""
        found: list[str | int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                if not part.isascii():
                    if is_newer(part):
                        found += self.newer_words(part)
                        continue
                    part = unicodedata.normalize("NFC", part)
                found += self.pieces.findall(part.lower() if "\u03a3" not in part else "".join(c.lower() for c in part))
        return found

    def newer_words(self, text: str) -> list[str]:
        """The words of a text with characters that Python's Unicode tables lack: cut by the library that reads the same
        file, whose tables decide what is a letter. Its pieces come as byte symbols."""
        from tokenizers import Tokenizer as Reader

        if not hasattr(self, "reader"):
            self.reader = Reader.from_file(self.path)
        byte = {c: b for b, c in self.to_symbols.items()}
        pieces = self.reader.pre_tokenizer.pre_tokenize_str(self.reader.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in piece).decode() for piece, _ in pieces]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, joined by a space."""
        at, stored = self.offsets, self.stored
        return b"".join([stored[at[i] : at[i + 1]] for i in ids])[:-1].decode()


class Words(dict):
    """What is known of a word, found out when it is first asked for: number of ids, the ids in decimal, what they decode to.

    Decoding joins tokens by a space, so a text decodes to its words' parts, joined likewise."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str | int) -> tuple[int, str, str]:
        if len(self) >= MOST_WORDS:
            self.clear()
        ids = [word] if isinstance(word, int) else self.tokenizer.encode_word(word)
        got = self[word] = len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids)
        return got

    def encode(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the ids in decimal, and the decoded text."""
        found = list(map(self.__getitem__, self.tokenizer.words(text)))
        if not found:
            return 0, "", ""
        n, ids, decoded = zip(*found, strict=True)
        return sum(n), " ".join(ids), " ".join(decoded)


def encode_and_decode(docs: DataFrame, path: str, with_ids: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, the ids themselves if asked for, and the columns `also`.

    The vocabulary file is sent to the executors; no row is shuffled."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    kept = ["doc_id", *also]
    rows = docs.select(*kept, "text")

    def run(batches):
        words = Words(Tokenizer(SparkFiles.get(name)))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids_of, n, ids_sha, decoded_sha = [], [], [], []
            for text in texts:
                count, spelled, decoded = words.encode(text or "")
                n.append(count)
                ids_sha.append(sha256(spelled.encode()).hexdigest())
                decoded_sha.append(sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids_of.append(np.array(spelled.split(), np.int32))
            columns = [*[batch.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    given = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{given}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(common.documents(spark, sf_dir), vocabulary())
