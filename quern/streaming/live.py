"""Live observation of event streams: grids that close as time advances, late events counted, resumable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.grid import ceil_bucket, period_aggregates


def live_bars(events: DataFrame, step_us: int, late_us: int = 0) -> DataFrame:
    """Left-closed bars of a stream of events (symbol, ts, price, quantity, seq), each emitted once when its time is past.

    A bar waits ``late_us`` for late events; later ones are dropped by the watermark.
    """
    span = f"{step_us} microseconds"
    key = F.unix_micros("ts").cast("decimal(38,0)") * F.lit(10**13).cast("decimal(14,0)") + F.col("seq").cast("decimal(13,0)")
    rows = events.withWatermark("ts", f"{late_us} microseconds")
    out = rows.groupBy("symbol", F.window("ts", span)).agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("quantity").cast("decimal(38,8)").alias("volume"), F.count("*").alias("n"))
    return out.select("symbol", F.unix_micros("window.start").alias("bar"), "open", "high", "low", "close", "volume", "n")


def live_grid(events: DataFrame, origin: int, step: int) -> DataFrame:
    """Aggregates of right-closed buckets of a stream of unified events, in update mode: a bucket's row is emitted whenever it changes.

    Late events are folded into their bucket like any other, as long as its state is kept.
    """
    return events.groupBy("symbol", ceil_bucket(F.col("us"), origin, step).alias("bucket")).agg(*period_aggregates())


_OUT = "symbol string, bucket bigint, last double, volume double, trades bigint, late bigint"
_STATE = "bucket bigint, last double, last_us bigint, volume double, trades bigint, late bigint"


def live_state(events: DataFrame, origin: int, step: int) -> DataFrame:
    """One row for each symbol and closed bucket: the last price, running volume and trades, and late events so far.

    A bucket closes when an event of a later one arrives.  Late events are counted and
    still go into the running totals; they never change the last price of a newer time.
    The state of a symbol is six numbers, so nothing grows with the stream.
    """

    def step_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, last, last_us, volume, trades, late = state.get if state.exists else (None, None, None, 0.0, 0, 0)
        rows, out = pd.concat(list(batches)).sort_values(["us", "seq"]), []
        for us, price, quantity in zip(rows["us"], rows["price"], rows["quantity"]):
            b = origin + -(-max(0, us - origin) // step) * step
            if bucket is not None and b > bucket:
                out.append((key[0], bucket, last, volume, trades, late))
            elif bucket is not None and b < bucket:
                late += 1
            bucket = b if bucket is None else max(b, bucket)
            volume, trades = volume + float(quantity), trades + 1
            if last_us is None or us >= last_us:
                last, last_us = float(price), int(us)
        state.update((bucket, last, last_us, volume, trades, late))
        yield pd.DataFrame(out, columns=["symbol", "bucket", "last", "volume", "trades", "late"])

    return events.groupBy("symbol").applyInPandasWithState(step_on, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_labels(observed: DataFrame, horizon_us: int, late_us: int = 0) -> DataFrame:
    """Observations of a stream (symbol, ts, price) on a regular grid, each joined with the one a horizon later.

    What waits is bounded: the watermark drops observations older than the horizon.
    """
    now = observed.withWatermark("ts", f"{late_us} microseconds").select("symbol", "ts", "price")
    then = observed.withWatermark("ts", f"{late_us} microseconds").select(F.col("symbol").alias("s"), F.col("ts").alias("observed_at"), F.col("price").alias("future"))
    both = now.join(then, F.expr(f"symbol = s AND observed_at = ts + INTERVAL '{horizon_us / 1e6}' SECOND"))
    return both.select("symbol", "ts", "observed_at", "price", "future", (F.try_divide("future", "price") - 1).alias("ret"))


def run_now(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Process all a stream has now into Parquet below ``path``; a later call goes on from there."""
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/version={n}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
