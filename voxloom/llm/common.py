"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.storage import shared_folder

#: A word is a maximal run of characters other than these six; bytes.split() cuts at exactly the same ones.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Texts are handed to vectorised code in pieces of about so many characters, which bounds a task's memory.
BATCH_CHARS = 4_000_000
#: Keys that a join treats by themselves: so many at most, with so many rows each at least.
MOST_HOT, LEAST_HOT = 1000, 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """All words of a text, in order; no words for null or empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACE_CHARS, "")


#: Paths of the tables that are being written within cleared(), the innermost last; each thread has its own.
_clearing: ContextVar[tuple[list[str], ...]] = ContextVar("clearing", default=())


def written(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again. Lost executors cost no recomputation.

    Within cleared() the table goes with the others at its end; if it is to be kept, at the end of the next one outside.
    Tables that hold texts take zstd."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    open_lists = _clearing.get()
    if len(open_lists) > keep:
        open_lists[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession):
    """Remove the tables that are written within, so nothing that is read after it may need them."""
    paths: list[str] = []
    token = _clearing.set((*_clearing.get(), paths))
    try:
        yield
    finally:
        _clearing.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_each(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and, in `n`, how many of the rows have that key.

    Keys of more than a MOST_HOT-th part of all rows, of which there are at most MOST_HOT, are broadcast and their rows
    stay where they are; the others are dealt by key. So no task gets a key with more rows than that. The table should be
    written, as it is read several times, and narrow."""
    many = F.col(n) > max(LEAST_HOT, (table.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(table.where(many).drop(n))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.where(~many).drop(n), on)
    return rows.join(hot, on).unionByName(rest)


def removed(df: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_pieces(texts: list, most: int = BATCH_CHARS):
    """Ranges (from, to) over the texts, of about `most` characters each; a longer text is a piece of its own."""
    at = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
