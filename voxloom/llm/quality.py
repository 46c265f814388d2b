"""Quality rules: base counts of a text, and a hashed n-gram likelihood ratio against a trusted target.

Everything runs in DataFrame operations. Hashed features of all documents are counted into a fixed number of buckets
twice, for the raw corpus and for the trusted documents; a text's score is the mean, over its features, of the log ratio
of the two multinomials, the target's smoothed towards the corpus. A document is kept if it passes the base rules and its
score reaches the threshold.

Null and empty texts have no words, score 0 and fail the base rules. Repeated rows are scored alike, each by itself.
With no trusted documents both multinomials are the same: every score is 0 and only the base rules decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import common

#: Buckets of the hashed features. The weight table has this many doubles whatever the corpus (512 KB).
BUCKETS = 65_536
#: The trusted target is fitted on so many labelled documents at most, those of the smallest hashed ids.
TRUSTED = 20_000
#: Words and pairs of the raw corpus, for each bucket on average, that are added to the target. Documents that the target
#: doesn't hold are then not punished for pairs that it happens to lack.
SMOOTHING = 10.0
THRESHOLD = -0.06
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5


def with_repeated_words(docs: DataFrame, words: str = "_words") -> DataFrame:
    """Add n_repeat_words: words covered by those 5-word windows that occur twice or more in the text.

    Equal windows are found by sorting (hash, position), so the work is n log n for any number of repeats. Each array
    is a column of its own: an array expression within a lambda would be computed again for every element."""
    n, last = F.size(words), F.size("_placed") - 1
    return (
        docs.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(
            "_grams",
            F.transform(
                F.slice("_h", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
                lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, WINDOW)]),
            ),
        )
        .withColumn(
            "_placed",
            F.when(
                F.size(F.array_distinct("_grams")) < F.size("_grams"),
                F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
            ),
        )
        .withColumn(
            "_at",
            F.sort_array(
                F.transform(
                    F.filter(
                        "_placed",
                        lambda x, k: ((k > 0) & (F.get("_placed", k - 1)["g"] == x["g"]))
                        | ((k < last) & (F.get("_placed", k + 1)["g"] == x["g"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        .withColumn(
            "n_repeat_words",
            F.coalesce(
                F.aggregate(
                    F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
                F.lit(0),
            ).cast("long"),
        )
        .drop("_h", "_grams", "_placed", "_at")
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add _words and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = common.text_or_empty(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda gone: (F.char_length(t) - F.char_length(F.translate(t, gone, ""))).cast("long")
    counted = (
        docs.withColumn("_words", common.words(t))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(common.without_spaces(t)).cast("long"))
        .withColumn("n_symbols", chars(SYMBOLS))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
    )
    return with_repeated_words(counted).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")),
    )


def features(words: str, buckets: int) -> Column:
    """Buckets of the hashed words and word pairs of a column of words, in order."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(F.get(words, i), w))
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of at most `most` trusted documents: labelled quality 1, smallest hashed ids first."""
    return (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each bucket's probability in the trusted documents and in the whole corpus.

    Counted map-side before one shuffle of at most `buckets` rows from each task; `buckets` numbers reach the driver."""
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted_ids(labels, trusted).withColumn("_trusted", F.lit(1))), "doc_id", "left"
    )
    counted = (
        flagged.withColumn("_words", common.words(F.col("text")))
        .select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(features("_words", buckets)).alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    )
    everything = W.partitionBy()  # at most as many rows as there are buckets
    prior = F.col("raw") / F.sum("raw").over(everything)
    pseudo, trusted_size = smoothing * buckets, F.sum("target").over(everything)
    mixed = (F.col("target") + pseudo * prior) / (trusted_size + pseudo)
    weighed = counted.select("b", F.when(trusted_size == 0, 0.0).otherwise(F.log(mixed / prior)).alias("w"))
    table = np.zeros(buckets)  # what a literal array is made from
    for b, w in weighed.toLocalIterator():
        table[b] = w
    return table


def with_score(docs: DataFrame, weight: np.ndarray, words: str = "_words") -> DataFrame:
    """Add score, the mean weight of a text's features; 0 without any."""
    table = F.lit(weight)
    return (
        docs.withColumn("_got", features(words, len(weight)))
        .withColumn(
            "score",
            F.when(F.size("_got") == 0, F.lit(0.0)).otherwise(
                F.aggregate("_got", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size("_got")
            ),
        )
        .drop("_got")
    )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The documents with the base columns, score and kept; works with any other columns of the input."""
    w = weights(docs, labels, **fit)
    return (
        with_score(base_counts(docs), w)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("_words")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.documents(spark, sf_dir).select("doc_id", "text"), common.labels(spark, sf_dir))
    return judged.drop("text")
