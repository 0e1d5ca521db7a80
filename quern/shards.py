"""Time shards: how one busy stream is split over many tasks.

A *stream* (a key such as symbol and venue) may hold a third of all rows, so no
operator here sorts or folds a stream as a whole.  Rows are grouped by stream
*and* time shard; what needs rows on both sides of a shard's edge is settled
afterwards, on the few rows next to the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the busiest stream should hold in one shard.
SHARD_ROWS = 60_000


@dataclass(frozen=True)
class ShardPlan:
    """width: of a shard, in the units of the time column; shards: how many the span has."""

    width: int
    shards: int

    def of(self, ts: Column) -> Column:
        """The shard of a time: whole multiples of the width below it, or 0 where one shard has all."""
        if self.shards == 1:
            return F.lit(0).cast("bigint")
        return ((ts - F.pmod(ts, F.lit(self.width))) / F.lit(self.width)).cast("bigint")

    def first(self, shard: Column) -> Column:
        """The earliest time of a shard."""
        return F.lit(-(2**62)) if self.shards == 1 else shard * self.width

    def last(self, shard: Column) -> Column:
        return F.lit(2**62) if self.shards == 1 else (shard + 1) * self.width - 1


def plan_shards(df: DataFrame, keys: list[str], ts: str, rows: int = SHARD_ROWS, least: int = 1) -> ShardPlan:
    """Width at which the busiest stream has about ``rows`` rows a shard.

    One pass over the keys and the time, combined before its small shuffle; only
    one row comes to the driver.  The span is that between the 1st and 99th
    percentile, so stray times make no shards too wide.
    """
    per = df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(ts, F.array(F.lit(0.01), F.lit(0.99)), 1000).alias("p"))
    got = per.agg(F.max("n").alias("n"), F.min(F.col("p")[0]).alias("lo"), F.max(F.col("p")[1]).alias("hi")).first()
    if got is None or not got["n"]:
        return ShardPlan(max(1, least), 1)
    span = max(1, int(got["hi"]) - int(got["lo"]) + 1)
    count = max(1, -(-int(got["n"]) // rows))
    width = max(least, -(-span // count), 1)
    return ShardPlan(width, max(1, -(-span // width)))
