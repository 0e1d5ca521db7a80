"""What happened afterwards: labels by time or by count, excursions, hypothesis tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.asof import asof
from quern.operators.running import block_window, in_blocks, own_rows
from quern.shards import SHARD_ROWS, ShardPlan, plan_shards


def future_return(now: str, then: str) -> Column:
    """then / now - 1; null where now is null or 0."""
    return F.try_divide(F.col(then).cast("double"), F.nullif(F.col(now).cast("double"), F.lit(0.0))) - 1


def label_after(rows: DataFrame, price: str, horizon: int, ts: str = "bucket", keys: Sequence[str] = ("symbol",), cap: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each row with the first row at or after ts + horizon: observed_at, future, ret.

    ``cap``: a label still open when so many later rows have come resolves on the last
    of them.  Rows whose label never resolves are left out.
    """
    facts = rows.select(*keys, F.col(ts).alias("at"), F.col(ts).alias("observed_at"), F.col(price).alias("future"))
    probes = rows.withColumn("due", F.col(ts) + horizon)
    plan = plan_shards(facts, list(keys), "at", shard_rows)
    if cap:
        blocks = in_blocks(probes, keys, ts, [], after=cap, plan=plan, rows=shard_rows)
        probes = own_rows(blocks.withColumn("due", F.least("due", F.lead(ts, cap).over(block_window(keys)))))
    out = asof(probes, facts, keys, "due", "at", ["observed_at", "future"], forward=True, plan=plan).where(F.col("observed_at").isNotNull()).drop("due")
    return out.withColumn("ret", future_return(price, "future"))


def label_by_count(rows: DataFrame, price: str, counts: Sequence[int], ts: str = "bucket", keys: Sequence[str] = ("symbol",), plan: ShardPlan | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each row with ret_<n>, the return to the n-th row after it; null where there is none.

    In blocks of rows that hold as many after them as the greatest count.
    """
    out = in_blocks(rows, keys, ts, [], after=max(counts), plan=plan, rows=shard_rows)
    w = block_window(keys)
    for n in counts:
        out = out.withColumn(f"f_{n}", F.lead(price, n).over(w))
    out = own_rows(out)
    for n in counts:
        out = out.withColumn(f"ret_{n}", future_return(price, f"f_{n}")).drop(f"f_{n}")
    return out


def excursions(rows: DataFrame, price: str, horizon: int, ts: str = "bucket", keys: Sequence[str] = ("symbol",), plan: ShardPlan | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each row with mfe and mae: the greatest and least return within (ts, ts + horizon].

    In time shards no narrower than the horizon, each with the rows of the next that it
    reaches into.
    """
    plan = plan or plan_shards(rows, list(keys), ts, shard_rows, least=horizon)
    cut = rows
    if plan.shards > 1:
        here = plan.of(F.col(ts))
        cut = rows.withColumn("_home", here).withColumn("_block", F.explode(F.array_distinct(F.array(here, plan.of(F.col(ts) - horizon)))))
    else:
        cut = rows.withColumns({"_home": F.lit(0), "_block": F.lit(0)})
    w = Window.partitionBy(*keys, "_block").orderBy(ts).rangeBetween(1, horizon)
    out = cut.withColumn("top", F.max(price).over(w)).withColumn("low", F.min(price).over(w)).where(F.col("_home") == F.col("_block")).drop("_home", "_block")
    return out.withColumn("mfe", future_return(price, "top")).withColumn("mae", future_return(price, "low")).drop("top", "low")


def hypothesis(rows: DataFrame, when: Column, price: str, counts: Sequence[int], direction: str = "up") -> DataFrame:
    """For each horizon: how many triggered rows resolved, their mean return, share that rose, and share that went on in the direction."""
    labelled = label_by_count(rows.withColumn("triggered", when), price, counts).where("triggered")
    long = labelled.select(F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"ret_{n}").alias("ret")) for n in counts])).alias("x")).select("x.*")
    right = F.col("ret") > 0 if direction == "up" else F.col("ret") < 0
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return long.where(F.col("ret").isNotNull()).groupBy("horizon").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 8).alias("mean_return"), rate(F.col("ret") > 0).alias("up_rate"), rate(right).alias("continuation_rate"))


def drift_report(rows: DataFrame, when: Column, price: str, counts: Sequence[int]) -> DataFrame:
    """Returns of triggered rows against those of all others: horizon, hit, n, mean_return, median_return (exact), hit_rate."""
    labelled = label_by_count(rows.withColumn("hit", when), price, counts)
    long = labelled.select("hit", F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"ret_{n}").alias("ret")) for n in counts])).alias("x")).select("hit", "x.*").where("ret IS NOT NULL")
    return long.groupBy("horizon", "hit").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_return"), F.percentile("ret", 0.5).alias("median_return"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"))
