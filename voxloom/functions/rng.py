"""Reproducible randomness: every draw is a function of a seed and keys, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *keys: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of the MD5 of seed and keys."""
    text = F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def integer(seed: str, n: Column | int, *keys: Column | str) -> Column:
    """An integer in 0..n-1."""
    return F.floor(uniform(seed, *keys) * n).cast("int")


def shuffle_key(seed: str, *keys: Column | str) -> Column:
    """A string to order rows by in random order."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))


def uniform_sql(seed: str, *keys: str) -> str:
    """uniform() in SQL for the comparison queries."""
    text = " || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def shuffle_sql(seed: str, *keys: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]]) + ")"
