"""The unified event stream: its schema, order, filters and adapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.job import JobSpec

PRICE = "decimal(18,8)"
#: Columns of an event; ``us`` is epoch microseconds, ``stream`` the place of its kind among the job's.
COLUMNS = {
    "symbol": "string", "venue": "string", "us": "bigint", "seq": "bigint", "stream": "int", "kind": "string", "price": PRICE, "quantity": PRICE, "side": "string",
    "bid_price": PRICE, "bid_size": PRICE, "ask_price": PRICE, "ask_size": PRICE,
    "open": PRICE, "high": PRICE, "low": PRICE, "close": PRICE, "action": "string",
}


def conform(df: DataFrame, kind: str, stream: int = 0, keep: Sequence[str] = (), **columns: Column | str) -> DataFrame:
    """Events of one kind under the unified schema; columns that aren't given are null.  Columns to ``keep`` follow as they are."""
    given = {k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items()}
    given |= {"kind": F.lit(kind), "stream": F.lit(stream)}
    return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()], *keep)


def order_key() -> Column:
    """The total order of a symbol's events as one number: time, sequence (missing first), stream.

    A DECIMAL(38,0) stays in the fixed-width part of a row, so aggregations by order
    remain hash aggregations.
    """
    wide = "decimal(38,0)"
    return (F.col("us").cast(wide) * F.lit(10**15).cast("decimal(16,0)") + F.coalesce(F.col("seq") + 1, F.lit(0)).cast("decimal(14,0)") * 10 + F.col("stream").cast("decimal(1,0)")).cast(wide)


def unified(streams: Sequence[DataFrame]) -> DataFrame:
    """All streams in one; put into order wherever order matters, by ``order_key``."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def select_events(events: DataFrame, job: JobSpec) -> DataFrame:
    """The job's symbols, venues, kinds (trade and bar stand for each other) and window, both ends included."""
    out = events.where(F.col("us").between(job.start, job.end))
    if job.symbols:
        out = out.where(F.col("symbol").isin(*job.symbols))
    if job.venues:
        out = out.where(F.col("venue").isin(*job.venues))
    if job.event_types:
        kinds = set(job.event_types)
        if kinds & {"trade", "bar"}:
            kinds |= {"trade", "bar"}
        out = out.where(F.col("kind").isin(*sorted(kinds)))
    return first_events(out, job.max_events) if job.max_events else out


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first n events of each symbol in total order.

    Spark keeps only n rows of a symbol in each task before the shuffle (window group
    limit), so a busy symbol sends no more than that.
    """
    w = Window.partitionBy("symbol").orderBy(order_key())
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


# ---- adapters over the driver's tables


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def user_trades(events: DataFrame, stream: int = 0) -> DataFrame:
    """Adapter A: each user's events as trades."""
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell").otherwise("unknown")
    return conform(events, "trade", stream, symbol=F.concat(F.lit("U"), "user_id"), venue=F.lit("driver"), us=F.unix_micros(F.col("ts").cast("timestamp")), seq="event_id", price="value", quantity=1 + _k() % 10, side=side)


def user_quotes(events: DataFrame, stream: int = 1) -> DataFrame:
    """Adapter B: each user's views and clicks as quotes."""
    rows = events.where(F.col("event_type").isin("view", "click") & (F.col("value") > 0.05))
    value = F.col("value").cast(PRICE)
    return conform(rows, "quote", stream, symbol=F.concat(F.lit("U"), "user_id"), venue=F.lit("driver"), us=F.unix_micros(F.col("ts").cast("timestamp")), seq="event_id", bid_price=value - F.lit("0.05").cast(PRICE), ask_price=value + F.lit("0.05").cast(PRICE), bid_size=1 + _k() % 7, ask_size=1 + F.floor(_k() / 7) % 7)


def user_book(events: DataFrame) -> DataFrame:
    """Adapter C: each user's events as changes of book levels of width 10; quantity 0 removes."""
    level = (F.floor(F.col("value") / 10) * 10).cast(PRICE)
    return conform(events, "book", 0, symbol=F.concat(F.lit("U"), "user_id"), venue=F.lit("driver"), us=F.unix_micros(F.col("ts").cast("timestamp")), seq="event_id", price=level, quantity=_k() % 20, side=F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask"), action=F.when(_k() % 20 == 0, "remove").otherwise("add"))
