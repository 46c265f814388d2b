"""Class algebra: distributions, weights, examples, splits, balancing and sampling. Rows carry no voxels.

A class may hold most of the rows, so rows are numbered by buckets within their class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import number, rng

def by_class():
    return W.partitionBy("molecule_id")



def by_id(samples: DataFrame, name: str) -> DataFrame:
    """Number the rows of each class in order of sample_id, from 1."""
    return number.numbered(samples, ["molecule_id"], number.of_ids("sample_id"), ["sample_id"], name)


def at_random(samples: DataFrame, seed: str, name: str) -> DataFrame:
    """Number the rows of each class in a random order, from 1."""
    keyed = samples.withColumn("_key", rng.shuffle_key(seed, "sample_id"))
    return number.numbered(keyed, ["molecule_id"], number.of_text(F.col("_key")), ["_key", "sample_id"], name).drop("_key")


def class_name(molecule_id: str | Column = "molecule_id") -> Column:
    m = F.col(molecule_id) if isinstance(molecule_id, str) else molecule_id
    return F.when(m == -1, "background").otherwise(F.concat(F.lit("class_"), m.cast("string")))


def counts(samples: DataFrame) -> DataFrame:
    """molecule_id and n; the one small aggregate that most operators here join back to."""
    return samples.groupBy("molecule_id").agg(F.count(F.lit(1)).alias("n"))


def distribution(samples: DataFrame) -> DataFrame:
    return counts(samples).select(class_name().alias("class_name"), "n")


def distribution_pct(samples: DataFrame) -> DataFrame:
    share = F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6)
    return distribution(samples).withColumn("pct", share)


def weights(samples: DataFrame) -> DataFrame:
    """total / class count of every sample."""
    per_class = counts(samples).withColumn("weight", F.round(F.sum("n").over(W.partitionBy()) / F.col("n"), 6))
    return samples.join(per_class, "molecule_id").select("sample_id", "weight")


def sampler_weights(samples: DataFrame) -> DataFrame:
    """Inverse class frequencies that sum to 1 over all samples."""
    per_class = counts(samples).withColumn("weight", F.round(1.0 / (F.count(F.lit(1)).over(W.partitionBy()) * F.col("n")), 12))
    return samples.join(per_class, "molecule_id").select("sample_id", "weight")


def draw(samples: DataFrame, n: int, seed: str = "draw") -> DataFrame:
    """n draws with replacement, every class equally likely: a class first, then a row of it, both by equi-join."""
    per_class = counts(samples)
    numbered = per_class.withColumn("k", F.row_number().over(W.orderBy("molecule_id")) - 1)
    rows = by_id(samples.select("sample_id", "molecule_id"), "row").withColumn("row", F.col("row") - 1)
    drawn = samples.sparkSession.range(n).select(F.col("id").alias("draw"))
    of_class = drawn.withColumn("k", rng.integer(f"{seed}-class", per_class.count(), "draw"))
    row = of_class.join(numbered, "k").withColumn("row", rng.integer(f"{seed}-row", F.col("n"), "draw"))
    return row.join(rows, ["molecule_id", "row"]).select("draw", "sample_id")


def draw_once(samples: DataFrame, n: int, seed: str = "once") -> DataFrame:
    """n rows without replacement, weighted by inverse class frequency: the largest ln(u) * count."""
    keyed = samples.join(counts(samples), "molecule_id").withColumn("key", F.log(F.greatest(rng.uniform(seed, "sample_id"), F.lit(1e-12))) * F.col("n"))
    return keyed.orderBy(F.desc("key"), "sample_id").limit(n).select("sample_id")


def subset(samples: DataFrame, n: int, seed: str = "subset") -> DataFrame:
    return samples.orderBy(rng.shuffle_key(seed, "sample_id"), "sample_id").limit(n).select("sample_id")


def split(samples: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2, seed: str = "split") -> DataFrame:
    """A stratified split: in each class int(n * train) rows, int(n * val), and the rest."""
    if abs(train + val + test - 1) > 1e-8:
        raise ValueError("the ratios must sum to 1")
    placed = at_random(samples.select("sample_id", "molecule_id"), seed, "at").join(counts(samples), "molecule_id")
    first, second = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    return placed.select("sample_id", "molecule_id", F.when(F.col("at") <= first, "train").when(F.col("at") <= first + second, "val").otherwise("test").alias("part"))


def undersample(samples: DataFrame, ratio: float = 1.0, seed: str = "under") -> DataFrame:
    """Each class down to n - int((n - smallest) * ratio) rows."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    goal = counts(samples).withColumn("goal", F.col("n") - F.floor((F.col("n") - F.min("n").over(W.partitionBy())) * F.lit(ratio)))
    return at_random(samples.select("sample_id", "molecule_id"), seed, "at").join(goal, "molecule_id").where("at <= goal").select("sample_id", "molecule_id")


def oversample(samples: DataFrame, ratio: float = 1.0, seed: str = "over") -> DataFrame:
    """Each class up to n + int((largest - n) * ratio) rows; copies are drawn with replacement and numbered from 1."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    more = counts(samples).withColumn("more", F.floor((F.max("n").over(W.partitionBy()) - F.col("n")) * F.lit(ratio)).cast("int")).where("more > 0")
    drawn = more.withColumn("copy", F.explode(F.sequence(F.lit(1), "more"))).withColumn("row", rng.integer(seed, F.col("n"), "molecule_id", "copy"))
    rows = by_id(samples.select("sample_id", "molecule_id"), "row").withColumn("row", F.col("row") - 1)
    copies = drawn.join(rows, ["molecule_id", "row"]).select("sample_id", "molecule_id", "copy")
    return samples.select("sample_id", "molecule_id", F.lit(0).alias("copy")).unionByName(copies)


def examples(samples: DataFrame, k: int = 1, seed: str | None = None) -> DataFrame:
    """k rows of each class, the first ones or random ones."""
    order = [rng.shuffle_key(seed, "sample_id"), F.col("sample_id")] if seed else [F.col("sample_id")]
    return samples.withColumn("rank", F.row_number().over(by_class().orderBy(*order))).where(F.col("rank") <= k).select("molecule_id", "rank", "sample_id")


def shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Round-robin workers for the distinct values of a key, in order. The values are a dimension such as run names."""
    return rows.select(key).distinct().withColumn("worker", (F.row_number().over(W.orderBy(key)) - 1) % n)


def key_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Class names that only one of two sets has."""
    a, b = (x.select(class_name().alias("class_name")).distinct() for x in (one, other))
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def proportions_agree(one: DataFrame, other: DataFrame, within: float = 0.05) -> DataFrame:
    """Whether each class has about the same share in both sets."""
    a, b = (x.groupBy(class_name().alias("class_name")).agg(F.count(F.lit(1)).alias("n")).select("class_name", (F.col("n") / F.sum("n").over(W.partitionBy())).alias(c)) for x, c in ((one, "p"), (other, "q")))
    both = a.join(b, "class_name", "full")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return both.select("class_name", F.round(F.abs(p - q), 9).alias("gap"), (F.abs(p - q) < within).alias("agrees"))
