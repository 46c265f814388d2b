"""Row numbers within large groups, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids that share a bucket.
IDS = 4096


def of_ids(key: str) -> Column:
    """Buckets of neighbouring ids, in their order."""
    return F.floor(F.col(key) / IDS)


def of_text(key: Column) -> Column:
    """Buckets by the first three characters of a hexadecimal key: 4096 of equal size."""
    return F.substring(key, 1, 3)


def numbered(rows: DataFrame, groups: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """Add the 1-based number of each row within its group. Buckets must follow the order.

    Rows are sorted within (group, bucket); the buckets' sizes alone are summed up within a group."""
    placed = rows.withColumn("_bucket", bucket)
    sizes = placed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy(*order))
    return placed.withColumn("_within", within).join(sizes, [*groups, "_bucket"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before")
