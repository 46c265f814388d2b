"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Text that people write, code included, packs several characters into a token of a byte-pair vocabulary; random strings
do not. Runs of key characters whose characters per token are at most a threshold are reported as `random`, unless a
fixed pattern already covers them or they are known to be something else: UUIDs, numbers and dates, hexadecimal digests
of usual lengths that are called so just before, integrity values, and identifiers, that is words joined by underscores,
slashes or capitals, most of them with a vowel. Everything else, runs of one letter case included, is left to the test.

Spans are code points, end exclusive. Spans of different kinds may overlap or start together; they come by start, then
kind as listed. Null texts count as empty, and like empty texts have no spans; a redacted null stays null. Every row is
scanned by itself, in whole, in one pass without a shuffle, so repeated rows and ids give repeated results, further
columns have no influence, and an empty table gives no rows. Tasks hold one batch of texts.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGNED = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: A candidate is a run of so many key characters at least. It is random at so few characters per token; in a run of
#: letters only, as long words are, each share of vowels counts as so many characters more, and the limit is another.
#: Fitted on generated keys and on the words of the tables (README).
LEAST_RUN, MOST_CHARS_PER_TOKEN, VOWEL_WEIGHT, MOST_OF_LETTERS = 16, 2.0, 2.0, 2.5
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: Runs that are no secrets, each matched against the whole run.
HARMLESS = re.compile(
    r"(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/]+=*"  # integrity values
    r"|[0-9_/+=-]+)"  # numbers, dates, rules
)
#: Digests, and the words one of which stands just before a known one.
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
CALLED_DIGEST = re.compile(r"(?:md5|sha-?\d+|digest|checksum|hash|commit|etag|fingerprint)\W{0,4}\Z", re.IGNORECASE)
#: What an identifier is joined from: words in one case or capitalised, with numbers at their ends, and short numbers.
JOINTS = re.compile(r"[_/=]+|(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[A-Za-z]?(?:[a-z]+|[A-Z]+)?[0-9]{0,5}")
SPOKEN = re.compile(r"[a-z]*[aeiouy][a-z]*", re.IGNORECASE)
#: The share of an identifier's letters that are in parts with a vowel, and the letters of a part on average, at least.
LEAST_SPOKEN, LEAST_LETTERS = 0.6, 2.5


def is_identifier(run: str) -> bool:
    parts = [p for p in JOINTS.split(run) if p]
    letters = [p.rstrip("0123456789") for p in parts]
    total = sum(map(len, letters))
    if len(parts) < 2 or not all(map(PART.fullmatch, parts)) or total < LEAST_LETTERS * len(parts):
        return False
    return sum(len(p) for p in letters if SPOKEN.fullmatch(p)) >= LEAST_SPOKEN * total


def is_known(run: str, before: str) -> bool:
    """Whether a run is no secret by its form, or by what stands before it."""
    if HARMLESS.fullmatch(run) or is_identifier(run):
        return True
    return len(run) in DIGEST_SIZES and bool(DIGEST.fullmatch(run)) and bool(CALLED_DIGEST.search(before))


def is_random(run: str, tokens_of) -> bool:
    each = len(run) / len(tokens_of(run))
    if run.isalpha():
        return each + VOWEL_WEIGHT * sum(map(run.lower().count, "aeiou")) / len(run) <= MOST_OF_LETTERS
    return each <= MOST_CHARS_PER_TOKEN


def scan(text: str, tokens_of) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed. tokens_of: text to a list of token ids."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = [(a, b) for a, b, _ in found]
    for m in RUN.finditer(text):
        if any(a < m.end() and m.start() < b for a, b in base):
            continue
        if is_random(m[0], tokens_of) and not is_known(m[0], text[max(0, m.start() - 20) : m.start()]):
            found.append((m.start(), m.end(), "random"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def tiktoken_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def find(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and found, an array of (start, end, kind), for every document."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    kind = "array<struct<start:long,end:long,kind:string>>"
    held = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        tokens_of = tiktoken_encoder(SparkFiles.get(name))
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind"), x, strict=True)) for x in scan(t or "", tokens_of)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(spans, held)], [*columns, "found"])

    given = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{given}, found {kind}")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by a mark of its kind; overlapping spans make one mark, of the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, path: str) -> DataFrame:
    """The documents with their secrets replaced and n_chars to match; other columns stay. Null texts stay null."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        tokens_of = tiktoken_encoder(SparkFiles.get(name))
        for batch in batches:
            texts = [t if t is None else redact(t, scan(t, tokens_of)) for t in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                was = columns[count].to_pylist()
                columns[count] = pa.array([n if t is None else len(t) for t, n in zip(texts, was, strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return find(common.documents(spark, sf_dir), vocabulary()).select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("found")).alias("spans"),
    )
