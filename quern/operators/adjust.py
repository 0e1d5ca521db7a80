"""Prices adjusted for corporate actions, and versions merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("raw", "adjusted", "split_adjusted", "scaled_raw", "total_return", "backwards_ratio", "panama")


def normalize(price: Column, mode: str, price_factor: Column | None = None, split_factor: Column | None = None, end_factor: Column | None = None, dividends: Column | None = None, offset: Column | None = None) -> Column:
    """A price under a mode of adjustment.

    raw: as it is; adjusted: by the factors of price and split; split_adjusted: of split;
    scaled_raw: adjusted relative to the factor at the end; total_return: split-adjusted
    plus the dividends so far; backwards_ratio: times the factor; panama: plus an offset.
    """
    p = price.cast("double")
    if mode == "raw":
        return p
    if mode == "adjusted":
        return p * price_factor * split_factor
    if mode == "split_adjusted":
        return p * split_factor
    if mode == "scaled_raw":
        return p * price_factor * split_factor / end_factor
    if mode == "total_return":
        return p * split_factor + F.coalesce(dividends, F.lit(0.0))
    if mode == "backwards_ratio":
        return p * price_factor
    if mode == "panama":
        return p + offset
    raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")


def scaled_volume(volume: Column, factor: Column) -> Column:
    """Volumes go the other way, to whole units."""
    return F.round(volume.cast("double") / factor)


def factors_from_actions(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, date, factor: the product of the ratios of all later actions, as exp of a sum of logs."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return actions.where(F.col("ratio") > 0).select(*keys, "date", F.exp(F.sum(F.log("ratio")).over(w)).alias("factor"))


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Old rows and new ones; of one key the row with the greatest version, new before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in version], F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def parse_factors(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``yyyyMMdd,price factor,split factor[,reference price]``; infinite or unreadable factors and dates are dropped."""
    p = F.split(column, ",")
    number = lambda i: F.expr(f"try_cast(split({column}, ',')[{i}] AS double)")
    out = lines.where(F.size(p) >= 3).select(F.expr(f"try_to_timestamp(split({column}, ',')[0], 'yyyyMMdd')").cast("date").alias("date"), number(1).alias("price_factor"), number(2).alias("split_factor"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    return out.where(F.col("date").isNotNull() & finite("price_factor") & finite("split_factor"))
