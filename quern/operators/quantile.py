"""Exact medians of weighted values, spread over many tasks however many values a group has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins for each doubling of a value.  A bin is looked into only if a median lies in it.
BINS = 64


def weighted_median(weights: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """keys, n, median (DOUBLE): of a table of whole values >= 0 that occur ``count`` times each.

    The number of values by bin tells in which bins the middle ones lie; only those are
    sorted.  The median of an even number is the mean of the middle two.  ``weights`` is
    read twice, so it should be a written table.  Groups without rows have no row.
    """
    keys = list(keys)
    rows = weights.select(*keys, F.col(value).alias("_x"), F.col(count).alias("_n"), F.floor(F.log2(F.col(value) + 1.0) * BINS).cast("int").alias("_bin"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    bins = bins.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    bins = bins.withColumn("_from", F.col("_upto") - F.col("_n")).where((F.col("_from") <= high) & (low < F.col("_upto")))
    near = rows.join(bins.select(*keys, "_bin", "_from", "_all"), [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x")
    near = near.withColumn("_b", F.col("_from") + F.sum("_n").over(inside)).withColumn("_a", F.col("_b") - F.col("_n"))
    at = lambda r: F.max(F.when((F.col("_a") <= r) & (r < F.col("_b")), F.col("_x")))
    return near.groupBy(*keys).agg(F.max("_all").alias("n"), ((at(low) + at(high)) / 2.0).alias("median"))
