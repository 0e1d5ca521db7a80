"""Repeated consecutive events collapsed into runs.

Each event is compared with its predecessor in its stream by a lag window;
changes are flagged, the flags summed into run identifiers, and each run
aggregated.  Streams are split into time shards; a run that crosses a shard's
edge is put together from its pieces by the same three steps, over one piece
for each edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shards import SHARD_ROWS, plan_shards
from quern.workdir import fresh_dir


def _near(value: Column, before: Column, step: Column) -> Column:
    """Less than half a step apart; without a usable step, exactly equal."""
    gap = F.abs(value - before)
    return F.coalesce(F.when(step > 0, gap * 2 < step).otherwise(gap == 0), F.lit(False))


def collapse_runs(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    tie: str,
    step: str | None = None,
    min_events: int = 1,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row for each maximal run: keys, start_ts, end_ts, n_events, duration.

    An event continues a run if each of ``values`` differs by less than half of
    the column ``step`` from the event just before it (drift within a run is
    allowed; without ``step``, or where it is null or not positive, values must be
    equal).  Events in order of ``ts``, then ``tie``.

    Defined results: an event with a null value belongs to no run and ends one;
    rows with a null key or ``ts`` belong to no stream and are left out; an exact
    repetition of a row is an event like any other; an empty table gives an empty
    result; other columns of ``events`` are never read, whatever their names.
    ``min_events`` leaves out shorter runs.
    """
    keys, values = list(keys), list(values)
    k = [f"k{i}" for i in range(len(keys))]
    v = [f"v{i}" for i in range(len(values))]
    rows = events.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(ts).alias("t"), F.col(tie).alias("tie"), *[F.col(c).alias(a) for c, a in zip(values, v)], (F.col(step) if step else F.lit(None).cast("decimal(18,8)")).alias("step"))
    for c in [*k, "t"]:
        rows = rows.where(F.col(c).isNotNull())
    plan = plan_shards(rows, k, "t", shard_rows)
    rows = rows.withColumn("shard", plan.of(F.col("t")))

    w = Window.partitionBy(*k, "shard").orderBy("t", "tie")
    whole, same = F.lit(True), F.lit(True)
    for c in v:
        whole = whole & F.col(c).isNotNull()
        same = same & _near(F.col(c), F.lag(c).over(w), F.col("step"))
    rows = rows.select("*", whole.alias("whole"), same.alias("same"), (F.row_number().over(w) == 1).alias("head"), F.lead("t").over(w).isNull().alias("tail"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w))
    piece = rows.groupBy(*k, "shard", "run").agg(
        F.min("t").alias("start"),
        F.max("t").alias("end"),
        F.count("*").alias("n"),
        F.max("head").alias("head"),
        F.max("tail").alias("tail"),
        F.min("whole").alias("whole"),
        F.max("step").alias("step"),
        *[F.max(F.when(F.col("head"), F.col(c))).alias(f"{c}_first") for c in v],
        *[F.max(F.when(F.col("tail"), F.col(c))).alias(f"{c}_last") for c in v],
    )
    # Pieces inside a shard are whole runs already.  Only those at the edges of a stream's
    # shards meet, two for each shard; all are written once, so that both ways read them.
    edge = F.col("head") | F.col("tail")
    piece = piece.where(edge | (F.col("whole") & (F.col("n") >= min_events)))
    at = fresh_dir(events.sparkSession, "runs")
    piece.write.parquet(at)
    piece = events.sparkSession.read.schema(piece.schema).parquet(at)
    inner = piece.where(~edge).select(*k, F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), F.col("n").alias("n_events"))
    w = Window.partitionBy(*k).orderBy("shard", "run")
    joins = F.col("head")
    for c in v:
        joins = joins & _near(F.col(f"{c}_first"), F.lag(f"{c}_last").over(w), F.col("step"))
    outer = piece.where(edge).withColumn("joins", joins).withColumn("whole_run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w))
    outer = outer.groupBy(*k, "whole_run").agg(F.min("start").alias("start_ts"), F.max("end").alias("end_ts"), F.sum("n").alias("n_events"), F.min("whole").alias("whole"))
    run = inner.unionByName(outer.where(F.col("whole") & (F.col("n_events") >= min_events)).drop("whole", "whole_run"))
    return run.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "start_ts", "end_ts", "n_events", (F.col("end_ts") - F.col("start_ts")).alias("duration"))
