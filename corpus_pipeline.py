"""The corpus pipeline: each stage works on all documents that the one before kept, written as Parquet between them.

Stages take and, but for the last, give the columns of documents; further columns are dropped. Each row is a document by itself,
whether its id is null or repeated. An empty table goes through every stage and stays empty. No stage keeps a copy of the
texts: rows are told apart by their place in the files they come from, so what is written on the way is narrow.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, common, mixing, near_dup, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What tells a row from all others: its file, and its number there.
ROW = ("_file", "_at")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with ROW. Rows that come from no files are written first."""
    try:
        return docs.select(*COLUMNS, F.xxhash64(docs["_metadata.file_path"]).alias("_file"), docs["_metadata.row_index"].alias("_at"))
    except AnalysisException:
        return numbered(common.written(docs.select(*COLUMNS), "rows", codec="zstd"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go; null and empty texts fail the base rules. Rows that
    repeat a text have its verdict.

    A filter on the verdict alone would be pushed below and repeat all of its expressions; none is pushed below a column
    that depends on the row's place."""
    judged = quality.judge(docs.select(*COLUMNS), common.labels(spark, sf_dir))
    placed = judged.select(*COLUMNS, "kept", F.monotonically_increasing_id().alias("_place"))
    return placed.where("kept AND _place >= 0").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: that of the smallest id, of equal ids that of
    the smallest hash of the text, of equal texts any one.

    Documents without words or without an id are in no group and stay. Different texts that share an id are documents by
    themselves."""
    rows = numbered(docs)
    with common.cleared(spark):
        found = near_dup.near_duplicates(rows, also=ROW).where("component IS NOT NULL")
        found = common.written(found.select("component", "doc_id", "hash", *ROW), "groups")
        stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "hash", *ROW)).alias("x")).select(*[f"x.{c}" for c in ROW])
        gone = common.written(found.join(stays, [*ROW], "left_anti").select(*ROW), "gone", keep=True)
    return rows.join(gone, [*ROW], "left_anti").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark of their kind; n_chars follows. Null texts stay null, and no row goes; where secrets
    overlap, the first one's mark stands for all."""
    return secrets.redacted(docs.select(*COLUMNS), secrets.vocabulary())


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, to the nearest whole number of times, in the curriculum's order:
    rows are range-sorted by the position of each time, so files and the rows in them follow it.

    Every row is mixed and repeated by itself, with or without an id; documents without words are not taken. Those of equal
    id and size are taken in the order of a hash of all their columns, and rows of one position come by id. Positions are
    found on narrow rows; the texts are shuffled to meet them, and once more into order."""
    rows = numbered(docs).withColumn("_hash", F.xxhash64(*COLUMNS))
    mixed = mixing.mix(rows, also=("_hash", *ROW)).where("taken > 0")
    times = mixed.select(*ROW, "positions", F.round(F.col("taken") / F.col("size")).cast("int").alias("_times")).where("_times > 0")
    taken = rows.join(times.select(*ROW, F.explode(F.slice("positions", F.lit(1), F.col("_times"))).alias("_position")), [*ROW])
    return taken.orderBy("_position", "doc_id", "_hash").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of them and of the decoded text; null texts count as empty, and equal
    texts have equal ids.

    training_order follows the rows' place in the files of the stage before, so sorting by it gives the curriculum; it
    rises with the position but has gaps. Rows that come from no files are numbered as they are partitioned."""
    return bpe.encode_and_decode(docs.withColumn("training_order", place_in_files(docs)), bpe.vocabulary(), with_ids=True, also=("training_order",))


def place_in_files(docs: DataFrame) -> Column:
    """The number in a part file's name, and the row's number in the file."""
    try:
        part = F.regexp_extract(docs["_metadata.file_name"], r"^part-(\d+)", 1).try_cast("long")
        return F.shiftleft(part, 36) + docs["_metadata.row_index"]
    except AnalysisException:
        return F.monotonically_increasing_id()


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
    ("BPE encoding", bpe_encoding),
]

#: Hashes of n-grams, sketches and token vocabularies have no counterpart in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. They read the table of the stage before, which stays; all others go once they are used."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with common.cleared(spark):
            after = common.written(stage(spark, docs, sf_dir), f"stage-{i}", keep=True, codec="zstd")
        if i:
            common.removed(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
