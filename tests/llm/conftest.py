from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from texts, numbered from 0; with a clashing extra column if asked for."""

    def make(texts, sources=None, extra=False):
        rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "score", "kept", "component", "fingerprint", "spans", "words", "id", "v"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
