"""Joins by time: as-of lookups, forward labels, step functions and intervals.

An as-of join is a union of both sides, sorted once for each key, with the last (or
first) value carried over; no pairs are made.  ``shard`` splits a busy key: rows are
cut at fixed times, and what a shard needs from others is the last row before it,
found from one row for each shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shards import SHARD_ROWS, ShardPlan, plan_shards


def asof(probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_ts: str, fact_ts: str, values: Sequence[str], forward: bool = False, strict: bool = False, tie: str | None = None, plan: ShardPlan | None = None) -> DataFrame:
    """Probes with the ``values`` of the last fact at or before their time (``forward``: the first at or after).

    ``strict``: never at the same time.  Of facts at one time the greatest ``tie`` counts
    (forward: the least).  A probe without a fact has nulls.  Probes keep their columns;
    values are added under their names, so these must not clash.
    """
    keys, values = list(keys), list(values)
    plan = plan or ShardPlan(2**62, 1)
    fact = F.struct(*[F.col(v) for v in values])
    a = probes.select(F.struct(*[F.col(c) for c in probes.columns]).alias("probe"), *keys, F.col(probe_ts).alias("t"), F.lit(None).cast("bigint").alias("tie"))
    b = facts.select(*keys, F.col(fact_ts).alias("t"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("tie"), fact.alias("fact"), F.lit(True).alias("has"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("shard", plan.of(F.col("t")))
    # Among rows of one time, facts come before probes unless the join is strict.
    rank = F.when(F.col("has"), 1 if strict else 0).otherwise(0 if strict else 1)
    both = both.withColumn("rank", rank)
    order = ["t", "rank", "tie"] if not forward else [F.col("t").desc(), F.col("rank"), F.col("tie").desc()]
    w = Window.partitionBy(*keys, "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("fact", True).over(w)
    if plan.shards > 1:
        edge = F.struct(F.col("t"), F.col("tie"), F.col("fact"))
        ends = b.withColumn("shard", plan.of(F.col("t"))).groupBy(*keys, "shard").agg((F.min if forward else F.max)(edge).alias("edge"))
        known = both.select(*keys, "shard").distinct().join(ends, [*keys, "shard"], "left")
        s = Window.partitionBy(*keys).orderBy(F.col("shard").desc() if forward else F.col("shard")).rowsBetween(Window.unboundedPreceding, -1)
        known = known.withColumn("beyond", F.last("edge", True).over(s)["fact"]).select(*keys, "shard", "beyond")
        both = both.withColumn("hit", hit).where(F.col("probe").isNotNull()).join(known, [*keys, "shard"], "left").withColumn("hit", F.coalesce("hit", "beyond"))
    else:
        both = both.withColumn("hit", hit).where(F.col("probe").isNotNull())
    return both.select("probe.*", *[F.col("hit")[v].alias(v) for v in values])


def _whole(df: DataFrame, c: str) -> Column:
    """A date as the number of its day, a time as microseconds, so that shards can be cut."""
    kind = df.schema[c].dataType.typeName()
    return F.unix_date(c).cast("bigint") if kind == "date" else F.unix_micros(c) if kind == "timestamp" else F.col(c).cast("bigint")


def step_lookup(facts: DataFrame, steps: DataFrame, keys: Sequence[str], date: str, step_date: str, value: str, default: Column, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Facts with the value of the first step dated at or after theirs, as price factors are given; else the default."""
    cols = facts.columns
    rows, known = facts.withColumn("_at", _whole(facts, date)), steps.withColumn("_step", _whole(steps, step_date)).withColumnRenamed(value, "_value")
    got = asof(rows, known, keys, "_at", "_step", ["_value"], forward=True, plan=plan_shards(rows, list(keys), "_at", shard_rows))
    return got.select(*cols, F.coalesce("_value", default).alias(value))


def interval_lookup(facts: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, value: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Facts with the value whose span [start, end] holds their time; null without one.  Spans of a key do not overlap."""
    cols = facts.columns
    rows, known = facts.withColumn("_at", _whole(facts, at)), spans.select(key, _whole(spans, start).alias("_start"), _whole(spans, end).alias("_end"), F.col(value).alias("_value"))
    got = asof(rows, known, [key], "_at", "_start", ["_end", "_value"], plan=plan_shards(rows, [key], "_at", shard_rows))
    return got.select(*cols, F.when(F.col("_at") <= F.col("_end"), F.col("_value")).alias(value))


def clamp_lookup(facts: DataFrame, rates: DataFrame, date: str, rate_date: str, value: str) -> DataFrame:
    """Facts with the rate of their date, else the latest before, else the first there is.

    The rates (one row a day) are spread over all days of the facts first, so that the
    join is one of equal dates.
    """
    ends = facts.agg(F.min(date).alias("a"), F.max(date).alias("b")).join(rates.agg(F.min(rate_date).alias("c"), F.max(rate_date).alias("d")))
    days = ends.select(F.explode(F.sequence(F.least("a", "c"), F.greatest("b", "d"))).alias("day"))
    known = days.join(rates.select(F.col(rate_date).alias("day"), F.col(value).alias("rate")), "day", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    filled = known.select("day", F.coalesce(F.last("rate", True).over(w), F.first("rate", True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias(value))
    return facts.join(filled, facts[date] == filled["day"], "left").select(*[facts[c] for c in facts.columns], value)


def venue_spreads(mids: DataFrame, keys: Sequence[str] = ("symbol", "at_us"), venue: str = "venue", mid: str = "mid") -> DataFrame:
    """keys, venue_a, venue_b, premium_bps: each two venues at the times they share, one row for each venue and time given.

    A symbol has as many rows at one time as venues quote it, so pairs stay few.
    """
    left = mids.select(*keys, F.col(venue).alias("venue_a"), F.col(mid).alias("_a"))
    right = mids.select(*keys, F.col(venue).alias("venue_b"), F.col(mid).alias("_b"))
    both = left.join(right, list(keys)).where("venue_a < venue_b")
    return both.select(*keys, "venue_a", "venue_b", ((F.col("_b") - F.col("_a")) / F.nullif(F.col("_a"), F.lit(0.0)) * 1e4).alias("premium_bps"))


def wide_merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables of one row for each key, side by side; a key that any of them has has a row.  Columns that are null throughout stay."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys), "full")
    return out
