"""Observations on a grid: right-closed buckets, gap filling, state carried forward.

All per-bucket values come from one hash aggregation (combined before its shuffle);
only then do windows run over a symbol's buckets, in time shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.events import order_key
from quern.plans.job import JobSpec
from quern.shards import SHARD_ROWS, ShardPlan, plan_shards

MISSING, FILLED, FRESH = 0, 1, 2
_SUM = "decimal(38,8)"


def ceil_bucket(us: Column, origin: int, step: int) -> Column:
    """The first grid point at or after a time; times before the origin belong to the origin."""
    over = us - F.lit(origin) + F.lit(step - 1)
    return F.greatest(F.lit(origin), F.lit(origin) + (over - F.pmod(over, F.lit(step))))


def period_aggregates() -> list[Column]:
    """Aggregates of a bucket's events; names ending in ``_at`` are state at its end, null if it has none."""
    trade, quote = F.col("kind") == "trade", F.col("kind") == "quote"
    last = F.col("kind").isin("trade", "bar")
    price = F.coalesce(F.when(F.col("kind") == "bar", F.col("close")), F.col("price"))
    mid = ((F.col("bid_price") + F.col("ask_price")) / 2).cast("decimal(18,8)")
    either = F.when(trade, F.col("price")).when(quote, mid)
    notional = (F.col("price") * F.col("quantity")).cast(_SUM)
    buy, sell = trade & (F.col("side") == "buy"), trade & (F.col("side") == "sell")
    key = order_key()
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast(_SUM)
    return [
        F.count_if(trade).alias("trade_count"),
        F.count_if(quote).alias("quote_count"),
        F.count("*").alias("event_count"),
        total(trade, F.col("quantity")).alias("trade_volume"),
        total(trade, notional).alias("notional"),
        total(buy, notional).alias("aggressive_buy_volume"),
        total(sell, notional).alias("aggressive_sell_volume"),
        (total(buy, F.col("quantity")) - total(sell, F.col("quantity"))).cast(_SUM).alias("signed_quantity"),
        total(last, F.coalesce(F.col("quantity"), F.lit(0))).alias("state_volume"),
        F.min_by(either, key).alias("open_at"),
        F.max_by(either, key).alias("close_at"),
        F.max(F.when(trade, F.col("price"))).alias("high_at"),
        F.min(F.when(trade, F.col("price"))).alias("low_at"),
        F.max_by(price, F.when(last, key)).alias("last_at"),
        *[F.max_by(c, F.when(quote & (F.col(p) > 0), key)).alias(f"{c}_at") for c, p in (("bid_price", "bid_price"), ("bid_size", "bid_price"), ("ask_price", "ask_price"), ("ask_size", "ask_price"))],
        F.max("us").alias("last_us_at"),
    ]


CARRIED = ("last", "bid_price", "bid_size", "ask_price", "ask_size", "last_us")


def bucketed(events: DataFrame, job: JobSpec) -> DataFrame:
    """symbol, bucket and the aggregates of each bucket that has events."""
    if job.step is None:
        return events.withColumn("bucket", F.col("us")).groupBy("symbol", "bucket", "seq", "stream").agg(*period_aggregates())
    return events.groupBy("symbol", ceil_bucket(F.col("us"), job.origin, job.step).alias("bucket")).agg(*period_aggregates())


def grid_points(symbols: DataFrame, job: JobSpec) -> DataFrame:
    """symbol, bucket: every grid point from the snapped start up to the end."""
    first = job.origin + -(-max(0, job.start - job.origin) // job.step) * job.step
    # In two steps, so that no row holds an array of all points.
    block = job.step * 10_000
    blocks = symbols.select("symbol", F.explode(F.sequence(F.lit(first), F.lit(max(first, job.end)), F.lit(block))).alias("b"))
    return blocks.select("symbol", F.explode(F.sequence(F.col("b"), F.col("b") + (block - job.step), F.lit(job.step))).alias("bucket")).where(F.col("bucket") <= job.end)


def snapshot(observed: DataFrame) -> DataFrame:
    """The state of each symbol after its last observation: what a later run needs to go on."""
    state = F.struct("bucket", *CARRIED, "volume", "trades_so_far", "cumulative_flow")
    return observed.groupBy("symbol").agg(F.max_by(state, "bucket").alias("s")).select("symbol", "s.*")


def _seeded(got: DataFrame, seed: DataFrame) -> DataFrame:
    """Bucket rows with one more for each symbol, at its snapshot, that carries the state in."""
    rows = seed.select("symbol", "bucket", *[F.col(c).alias(f"{c}_at") for c in CARRIED], F.col("volume").cast(_SUM).alias("state_volume"), F.col("trades_so_far").alias("trade_count"), F.col("cumulative_flow").cast(_SUM).alias("signed_quantity"), F.lit(True).alias("seed"))
    ends = seed.select("symbol", F.col("bucket").alias("seen"))
    later = got.join(ends, "symbol", "left").where(F.col("seen").isNull() | (F.col("bucket") > F.col("seen"))).drop("seen")
    return later.withColumn("seed", F.lit(False)).unionByName(rows, allowMissingColumns=True)


#: Running columns of an observation, and the sums they run over.
RUNNING = {"volume": "state_volume", "trades_so_far": "trade_count", "cumulative_flow": "signed_quantity"}


def _carried(got: DataFrame, plan: ShardPlan, order: list[str]) -> DataFrame:
    """Bucket rows with state carried forward and running sums, within time shards and then across them.

    What a shard takes over comes from one row for each shard, so no task sorts a whole
    symbol, be it one of a fine grid or of every event.
    """
    lasts = [c for c in CARRIED if c != "last_us"]
    got = got.withColumn("_shard", plan.of(F.col("bucket")))
    w = Window.partitionBy("symbol", "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = got.withColumns({c: F.last(f"{c}_at", True).over(w) for c in lasts} | {"last_us": F.max("last_us_at").over(w)} | {c: F.sum(x).over(w) for c, x in RUNNING.items()})
    if plan.shards > 1:
        key = F.struct(*[F.coalesce(c, F.lit(-1)).alias(c) for c in order])
        ends = got.groupBy("symbol", "_shard").agg(*[F.max_by(f"{c}_at", F.when(F.col(f"{c}_at").isNotNull(), key)).alias(f"_{c}") for c in lasts], F.max("last_us_at").alias("_last_us"), *[F.sum(x).alias(f"_{c}") for c, x in RUNNING.items()])
        before = Window.partitionBy("symbol").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("symbol", "_shard", *[F.last(f"_{c}", True).over(before).alias(f"_{c}") for c in lasts], F.max("_last_us").over(before).alias("_last_us"), *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in RUNNING])
        out = out.join(ends, ["symbol", "_shard"])
        out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in lasts} | {"last_us": F.greatest("last_us", "_last_us")} | {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in RUNNING}).drop(*[f"_{c}" for c in (*CARRIED, *RUNNING)])
    return out.drop("_shard").withColumns({c: F.col(c).cast(_SUM) for c in ("volume", "cumulative_flow")})


def observations(events: DataFrame, job: JobSpec, seed: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each symbol and grid point (with fill_forward), or each bucket with events.

    Adds the carried state (``last``, ``bid_price``, ... null before the first event),
    ``volume`` and ``trades_so_far`` (running), ``data_quality`` and ``data_age_ms`` (-1:
    none).  A bucket beyond the end appears if events fall into it.  Symbols of the job
    without events have only missing rows.  ``seed``: a ``snapshot`` of an earlier run, of
    which this one continues with the buckets after it.
    """
    got = bucketed(events, job)
    keys = ["symbol", "bucket"]
    if job.step is not None and job.fill_forward:
        named = events.select("symbol").distinct()
        if job.symbols:
            named = events.sparkSession.createDataFrame([(s,) for s in job.symbols], "symbol string")
        got = grid_points(named, job).join(got, keys, "full")
    if seed is not None:
        got = _seeded(got, seed)
    counts = ("trade_count", "quote_count", "event_count")
    sums = ("trade_volume", "notional", "aggressive_buy_volume", "aggressive_sell_volume", "signed_quantity", "state_volume")
    got = got.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, F.lit(0)).cast(_SUM) for c in sums})
    if job.step is None:
        plan = plan_shards(events, ["symbol"], "us", shard_rows)
    else:
        shards = max(1, -(-((job.end - job.origin) // job.step + 1) // shard_rows))
        plan = ShardPlan(job.step * shard_rows, shards)
    out = _carried(got, plan, ["bucket"] if job.step else ["bucket", "seq", "stream"])
    if seed is not None:
        out = out.where(~F.col("seed")).drop("seed")
    out = out.withColumn("data_quality", F.when(F.col("event_count") > 0, FRESH).when(F.col("last_us").isNotNull(), FILLED).otherwise(MISSING))
    out = out.withColumn("data_age_ms", F.coalesce((F.col("bucket") - F.col("last_us")) / 1000.0, F.lit(-1.0)))
    if job.max_observations:
        n = Window.partitionBy("symbol").orderBy("bucket")
        out = out.withColumn("n", F.row_number().over(n)).where(F.col("n") <= job.max_observations).drop("n")
    return out


def floor_grid(events: DataFrame, step: int) -> DataFrame:
    """The older grid: left-closed buckets from the epoch, none that are empty."""
    return events.groupBy("symbol", (F.col("us") - F.pmod("us", F.lit(step))).alias("bucket")).agg(*period_aggregates())


def replay_statistics(events: DataFrame, job: JobSpec, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Events, late events (in order of arrival, ``seq``), buckets and empty grid points of each symbol."""
    b = ceil_bucket(F.col("us"), job.origin, job.step)
    plan = plan_shards(events, ["symbol"], "seq", shard_rows)
    rows = events.withColumn("bucket", b).withColumn("_shard", plan.of(F.col("seq")))
    w = Window.partitionBy("symbol", "_shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("newest", F.max("bucket").over(w))
    if plan.shards > 1:
        # The newest bucket of all shards before, from one row for each.
        past = Window.partitionBy("symbol").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy("symbol", "_shard").agg(F.max("bucket").alias("top")).select("symbol", "_shard", F.max("top").over(past).alias("past"))
        rows = rows.join(ends, ["symbol", "_shard"]).withColumn("newest", F.greatest("newest", "past"))
    rows = rows.withColumn("late", F.coalesce(F.col("bucket") < F.col("newest"), F.lit(False)))
    points = (job.end - job.start) // job.step + 1
    return rows.groupBy("symbol").agg(F.count("*").alias("n_events"), F.count_if("late").alias("n_late"), F.countDistinct("bucket").alias("n_buckets")).withColumn("n_empty", F.lit(points) - F.col("n_buckets"))
