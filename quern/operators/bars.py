"""Bars: consolidation by time, count, calendar, session, volume and price."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_CEILING, ROUND_HALF_DOWN, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.fold import fold
from quern.operators.running import ranked, running_sums

_SUM = "decimal(38,8)"


def order_of(us: str = "us", seq: str = "seq") -> Column:
    """Time and sequence as one number, for first and last within a bar."""
    return F.col(us).cast("decimal(38,0)") * F.lit(10**13).cast("decimal(14,0)") + F.col(seq).cast("decimal(13,0)")


def ohlcv(key: Column, price: str = "price", quantity: str = "quantity") -> list[Column]:
    return [F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum(quantity).cast(_SUM).alias("volume"), F.count("*").alias("n")]


def time_bars(ticks: DataFrame, period: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Left-closed bars of ``period`` microseconds from the epoch; empty ones don't exist."""
    start = F.col("us") - F.pmod("us", F.lit(period))
    return ticks.groupBy(*keys, start.alias("bar")).agg(*ohlcv(order_of()))


def calendar_bars(ticks: DataFrame, unit: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of a calendar unit: day, week (from Monday), month, quarter or year."""
    start = F.date_trunc(unit, F.timestamp_micros("us")).cast("date")
    return ticks.groupBy(*keys, start.alias("bar")).agg(*ohlcv(order_of()))


def count_bars(ticks: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of every n ticks; an incomplete last one is not emitted."""
    rows = ranked(ticks, keys, "us", ["seq"], "place").withColumn("bar", F.floor((F.col("place") - 1) / n).cast("bigint"))
    return rows.groupBy(*keys, "bar").agg(*ohlcv(order_of()), F.min("us").alias("start_us"), F.max("us").alias("end_us")).where(F.col("n") == n)


def merge_bars(bars: DataFrame, period: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Longer bars from shorter ones (bar, open, high, low, close, volume, n)."""
    start = F.col("bar") - F.pmod("bar", F.lit(period))
    return bars.groupBy(*keys, start.alias("bar")).agg(F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.sum("volume").cast(_SUM).alias("volume"), F.sum("n").alias("n"))


def quote_bars(quotes: DataFrame, period: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of bid and ask; each opens where the one before closed, and its range holds that price."""
    start = F.col("us") - F.pmod("us", F.lit(period))
    key = order_of()
    out = quotes.groupBy(*keys, start.alias("bar")).agg(*[x for s in ("bid", "ask") for x in (F.min_by(f"{s}_price", key).alias(f"{s}_open"), F.max(f"{s}_price").alias(f"{s}_high"), F.min(f"{s}_price").alias(f"{s}_low"), F.max_by(f"{s}_price", key).alias(f"{s}_close"))])
    return _from_last_close(out, keys)


def merge_quote_bars(bars: DataFrame, period: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Longer quote bars from shorter ones; each opens where the one before closed, as those of quotes do."""
    start = F.col("bar") - F.pmod("bar", F.lit(period))
    out = bars.groupBy(*keys, start.alias("bar")).agg(*[x for s in ("bid", "ask") for x in (F.min_by(f"{s}_open", "bar").alias(f"{s}_open"), F.max(f"{s}_high").alias(f"{s}_high"), F.min(f"{s}_low").alias(f"{s}_low"), F.max_by(f"{s}_close", "bar").alias(f"{s}_close"))])
    return _from_last_close(out, keys)


def _from_last_close(out: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("bar")
    for s in ("bid", "ask"):
        before = F.lag(f"{s}_close").over(w)
        out = out.withColumns({f"{s}_before": before})
    for s in ("bid", "ask"):
        b = F.col(f"{s}_before")
        out = out.withColumns({f"{s}_open": F.coalesce(b, F.col(f"{s}_open")), f"{s}_high": F.greatest(f"{s}_high", b), f"{s}_low": F.least(f"{s}_low", b)}).drop(f"{s}_before")
    return out


def last_values(rows: DataFrame, period: int, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last value of each period, as open interest is kept."""
    start = F.col("us") - F.pmod("us", F.lit(period))
    return rows.groupBy(*keys, start.alias("bar")).agg(F.max_by(value, order_of()).alias(value))


def volume_bricks(ticks: DataFrame, size: int, keys: Sequence[str] = ("symbol",), of: Column | None = None) -> DataFrame:
    """Bricks of equal volume (or of ``of``, such as price times quantity): a tick's excess rolls over.

    A tick takes part in every brick that its span of the running total touches.
    """
    rows = ticks.withColumn("q", (F.col("quantity") if of is None else of).cast("decimal(28,8)")).where(F.col("q") > 0)
    rows = running_sums(rows, keys, "us", ["seq"], {"upto": F.col("q")})
    a, b = F.col("upto") - F.col("q"), F.col("upto")
    first = F.floor(a / size).cast("bigint")
    last = F.ceil(b / size).cast("bigint") - 1
    rows = rows.withColumn("a", a).withColumn("bar", F.explode(F.sequence(first, last)))
    part = F.least(b, (F.col("bar") + 1) * size) - F.greatest(F.col("a"), F.col("bar") * size)
    key = order_of()
    return rows.withColumn("part", part.cast(_SUM)).groupBy(*keys, "bar").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("part").cast(_SUM).alias("volume"), F.count("*").alias("n"))


def session_bars(ticks: DataFrame, hours: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One bar a day from ticks within market hours (``hours``: weekday 1 Sunday to 7, open_us, close_us of the day)."""
    day = F.timestamp_micros("us").cast("date")
    rows = ticks.withColumn("bar", day).withColumn("weekday", F.dayofweek(day)).withColumn("us_of_day", F.pmod("us", F.lit(86_400_000_000)))
    rows = rows.join(hours, "weekday").where((F.col("us_of_day") >= F.col("open_us")) & (F.col("us_of_day") < F.col("close_us")))
    return rows.groupBy(*keys, "bar").agg(*ohlcv(order_of()))


# ---- bars that only a fold can build


class _Renko:
    """Bricks with wicks on a fixed lattice: a brick closes when a price goes beyond its far end; a turn needs two sizes.

    The state is the lattice point that the next brick starts from, the direction of the
    last brick, and the extremes since.
    """

    def __init__(self, size: Decimal):
        self.size, self.at, self.trend, self.top, self.bottom = size, None, 0, None, None

    def push(self, row):
        us, price = row
        if self.at is None:
            # The nearest multiple; half way between two, the lower.
            self.at = self.top = self.bottom = (price / self.size).to_integral_value(ROUND_HALF_DOWN) * self.size
            return []
        self.top, self.bottom = max(self.top, price), min(self.bottom, price)
        if price == self.at:
            return []
        way = 1 if price > self.at else -1
        # Against the trend, bricks start from where the last one did.
        base = self.at + way * self.size if self.trend == -way else self.at
        bricks = int(_whole_below((price - base) * way / self.size))
        if bricks < 1:
            return []
        out = []
        for n in range(bricks):
            a, b = base + way * n * self.size, base + way * (n + 1) * self.size
            wick = (self.bottom if way > 0 else self.top) if n == 0 else a
            out.append((us, a, b if way > 0 else wick, wick if way > 0 else b, b, way))
        self.at, self.trend = base + way * bricks * self.size, way
        if way > 0:
            self.bottom = self.at
        else:
            self.top = self.at
        return out

    def end(self):
        return []


def _whole_below(x: Decimal) -> Decimal:
    """The greatest whole number below x, not x itself."""
    return x.to_integral_value(ROUND_CEILING) - 1


class _ClassicRenko:
    """At most one brick for each price, open where the last closed; the first opens at a multiple of the size at or above the price."""

    def __init__(self, size: Decimal):
        self.size, self.open, self.low, self.high = size, None, None, None

    def push(self, row):
        us, price = row
        if self.open is None:
            self.open = self.low = self.high = (price / self.size).to_integral_value(ROUND_CEILING) * self.size
            return []
        close = min(self.open + self.size, max(self.open - self.size, price))
        self.low, self.high = min(self.low, close), max(self.high, close)
        if abs(price - self.open) < self.size:
            return []
        out = [(us, self.open, self.high, self.low, close, 1 if close > self.open else -1)]
        self.open = self.low = self.high = close
        return out

    def end(self):
        return []


class _Range:
    """Bars that span a fixed range.  A price beyond it closes the bar; the next opens one tick further on.

    A jump leaves bars without volume in between.  The first bar opens at a multiple of
    the range at or above the price.  ``classic``: the next bar opens at the price itself.
    """

    def __init__(self, size: Decimal, tick: Decimal, classic: bool):
        self.size, self.tick, self.classic = size, tick, classic
        self.open = self.low = self.high = None
        self.volume = Decimal(0)

    def _start(self, at: Decimal, volume: Decimal) -> None:
        self.open, self.low, self.high, self.volume = at, at, at, volume

    def push(self, row):
        us, price, quantity = row
        quantity, out = quantity or Decimal(0), []
        if self.open is None:
            self._start((price / self.size).to_integral_value(ROUND_CEILING) * self.size, quantity)
            return out
        up = price > self.high
        while (price - self.low if up else self.high - price) > self.size:
            far = self.low + self.size if up else self.high - self.size
            out.append((us, self.open, far if up else self.high, self.low if up else far, far, 1 if up else -1, self.volume))
            if self.classic:
                self._start(price, quantity)
                return out
            self._start(far + self.tick if up else far - self.tick, Decimal(0))
        self.low, self.high, self.volume = min(self.low, price), max(self.high, price), self.volume + quantity
        return out

    def end(self):
        return []


class _Mixed:
    """A bar ends after so many ticks or so long a time, whichever comes first."""

    def __init__(self, count: int, period: int):
        self.count, self.period, self.bar = count, period, None

    def _close(self):
        out, self.bar = [tuple(self.bar)], None
        return out

    def push(self, row):
        us, price = row
        out = []
        if self.bar and us >= self.bar[0] + self.period:
            out = self._close()
        if self.bar is None:
            self.bar = [us - us % self.period, price, price, price, price, 0]
        b = self.bar
        b[2], b[3], b[4], b[5] = max(b[2], price), min(b[3], price), price, b[5] + 1
        return out + (self._close() if b[5] == self.count else [])

    def end(self):
        return []


_BRICK = "us bigint, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), direction int"


def _fold_bars(ticks: DataFrame, keys: Sequence[str], start) -> DataFrame:
    return fold(ticks.where(F.col("price").isNotNull()), keys, ["us", "seq"], ["us", "price"], start, _BRICK)


def renko_bars(ticks: DataFrame, size: str, keys: Sequence[str] = ("symbol",), classic: bool = False) -> DataFrame:
    """Price bricks with wicks, or the classic ones."""
    kind, s = (_ClassicRenko if classic else _Renko), Decimal(size)
    return _fold_bars(ticks, keys, lambda: kind(s))


def range_bars(ticks: DataFrame, size: str, keys: Sequence[str] = ("symbol",), tick: str = "0.01", classic: bool = False) -> DataFrame:
    """Bars of a price range, with volume; ``tick`` is the least change of a price.  Classic ones open at the price that closed the last."""
    s, t = Decimal(size), Decimal(tick)
    rows = ticks.where(F.col("price").isNotNull()).withColumn("quantity", F.col("quantity").cast("decimal(28,8)"))
    return fold(rows, keys, ["us", "seq"], ["us", "price", "quantity"], lambda: _Range(s, t, classic), _BRICK + ", volume decimal(28,8)")


def mixed_bars(ticks: DataFrame, count: int, period: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    out = "bar bigint, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), n int"
    return fold(ticks.where(F.col("price").isNotNull()), keys, ["us", "seq"], ["us", "price"], lambda: _Mixed(count, period), out)
