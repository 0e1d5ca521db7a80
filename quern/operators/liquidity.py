"""Liquidity transitions: depletion, replenishment, migration and walls of book depth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.labels import excursions, label_after
from quern.operators.running import block_window, in_blocks, own_rows
from quern.shards import SHARD_ROWS


@dataclass(frozen=True)
class Thresholds:
    """fraction, minimum: fall of depth that is a depletion; rise: share that is a replenishment;
    move_bps: move of the best price that is a migration; wall: multiple of the median level; gap_us: longest step compared."""

    fraction: float = 0.3
    minimum: float = 0.0
    rise: float = 0.3
    move_bps: float = 1.0
    wall: float = 3.0
    gap_us: int = 2_000_000


def transitions(states: DataFrame, t: Thresholds = Thresholds(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each transition: symbol, us, side, type, depth_before, depth_after, depth_delta.

    ``states``: symbol, us, bid_depth, ask_depth, best_bid, best_ask.  Rows are compared
    with the one before, unless it is too long ago or either lacks a side.  A side that
    depletes or replenishes does not migrate as well.
    """
    states = in_blocks(states, ["symbol"], "us", [], before=1, rows=shard_rows)
    w = block_window(["symbol"])
    was = {c: F.lag(c).over(w) for c in ("us", "bid_depth", "ask_depth", "best_bid", "best_ask")}
    rows = own_rows(states.withColumns({f"{c}_0": x for c, x in was.items()}))
    two = (F.col("best_bid") > 0) & (F.col("best_ask") > 0) & (F.col("best_bid_0") > 0) & (F.col("best_ask_0") > 0)
    rows = rows.where(two & (F.col("us") - F.col("us_0")).between(0, t.gap_us))

    def side(s: str) -> Column:
        a, b = F.col(f"{s}_depth_0").cast("double"), F.col(f"{s}_depth").cast("double")
        p0, p1 = F.col(f"best_{s}_0").cast("double"), F.col(f"best_{s}").cast("double")
        kind = F.when((a > 0) & (a - b >= F.greatest(a * t.fraction, F.lit(t.minimum))) & (a > b), "depletion").when((a > 0) & (b - a >= a * t.rise) & (b > a), "replenishment").when(F.abs(p1 - p0) / p0 * 1e4 >= t.move_bps, "migration")
        return F.struct(F.lit(s).alias("side"), kind.alias("type"), a.alias("depth_before"), b.alias("depth_after"), (b - a).alias("depth_delta"))

    out = rows.select("symbol", "us", F.explode(F.array(side("bid"), side("ask"))).alias("x")).select("symbol", "us", "x.*")
    return out.where("type IS NOT NULL")


def walls(states: DataFrame, t: Thresholds = Thresholds(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows whose best level of a side is ``wall`` times the upper median of the side's levels, where the one before was not.

    ``states`` has bids and asks, arrays of price and quantity, best first.
    """
    states = in_blocks(states, ["symbol"], "us", [], before=1, rows=shard_rows)
    w = block_window(["symbol"])

    def big(s: str) -> Column:
        q = F.transform(s, lambda x: x["quantity"].cast("double"))
        return F.when(F.size(q) > 1, q[0] >= t.wall * F.element_at(F.array_sort(q), (F.floor(F.size(q) / 2) + 1).cast("int"))).otherwise(False)

    rows = states.withColumns({"bid": big("bids"), "ask": big("asks")})
    rows = own_rows(rows.withColumns({f"{s}_new": F.col(s) & ~F.coalesce(F.lag(s).over(w), F.lit(False)) for s in ("bid", "ask")}))
    return rows.select("symbol", "us", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_new").alias("new")) for s in ("bid", "ask")])).alias("x")).where("x.new").select("symbol", "us", "x.side", F.lit("wall_formation").alias("type"))


def replenished(events: DataFrame, lookback_us: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Depletions with ms_until_replenishment: the next event of the side, if it is a replenishment soon enough."""
    rows = events.where(F.col("type").isin("depletion", "replenishment"))
    rows, w = in_blocks(rows, ["symbol", "side"], "us", [], after=1, rows=shard_rows), block_window(["symbol", "side"])
    rows = own_rows(rows.withColumns({"next_type": F.lead("type").over(w), "next_us": F.lead("us").over(w)}))
    ok = (F.col("next_type") == "replenishment") & (F.col("next_us") - F.col("us") <= lookback_us)
    return rows.where("type = 'depletion'").select("symbol", "side", "us", F.when(ok, (F.col("next_us") - F.col("us")) / 1000.0).alias("ms_until_replenishment"))


def event_metrics(events: DataFrame) -> DataFrame:
    """Counts and mean changes of depth by type and side, with subtotals."""
    return events.rollup("type", "side").agg(F.count("*").alias("n"), F.round(F.avg("depth_delta"), 6).alias("mean_delta"))


def since_last(events: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Events with ms_since_last: since the last earlier time at which their symbol had any; -1 for the first."""
    times = in_blocks(events.select("symbol", "us").distinct(), ["symbol"], "us", [], before=1, rows=shard_rows)
    w = block_window(["symbol"])
    times = own_rows(times.withColumn("ms_since_last", F.coalesce((F.col("us") - F.lag("us").over(w)) / 1000.0, F.lit(-1.0))))
    return events.join(times, ["symbol", "us"])


def outcomes(events: DataFrame, prices: DataFrame, horizons: Sequence[int], price: str = "mid", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Events with what their symbol's price did after them: horizon, ret, mfe and mae, a row for each of the horizons (microseconds).

    ``prices``: symbol, us and the price, with a row at the time of each event; ret is null
    while the price a horizon later is unknown, mfe and mae while there is none within it.
    """
    rows = prices.select("symbol", "us", F.col(price).cast("double").alias("_p"))
    out = None
    for h in horizons:
        ret = label_after(rows, "_p", h, ts="us", shard_rows=shard_rows).select("symbol", "us", "ret")
        far = excursions(rows, "_p", h, ts="us", shard_rows=shard_rows).select("symbol", "us", "mfe", "mae").join(ret, ["symbol", "us"], "left")
        one = events.join(far, ["symbol", "us"], "left").withColumn("horizon", F.lit(h).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def outcome_metrics(rows: DataFrame) -> DataFrame:
    """Of ``outcomes``, for each type, side and horizon: events, those resolved, mean return, share that rose, mean excursions."""
    return rows.groupBy("type", "side", "horizon").agg(F.count("*").alias("n"), F.count("ret").alias("n_resolved"), F.avg("ret").alias("mean_ret"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("up_rate"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))


def rates(events: DataFrame) -> DataFrame:
    """symbol, type, n, per_minute: how often each type happens between a symbol's first and last event."""
    span = events.groupBy("symbol").agg(((F.max("us") - F.min("us")) / 60e6).alias("minutes"))
    n = events.groupBy("symbol", "type").agg(F.count("*").alias("n"))
    return n.join(span, "symbol").select("symbol", "type", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.nullif(F.col("minutes"), F.lit(0.0))), F.lit(0.0)).alias("per_minute"))


def subtotals(rows: DataFrame, dimensions: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Measures of all combinations of dimensions and of their subtotals, named ``*``; a null value is named so too."""
    return rows.cube(*dimensions).agg(*measures).withColumns({c: F.coalesce(c, F.lit("*")) for c in dimensions})
