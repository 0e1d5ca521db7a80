"""Orders against bars: first touches, slippage, fees, payoffs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.fold import fold


#: Orders of one symbol that wait in one task at most; those of a busier symbol are split, as no order hangs on another.
PART_ORDERS = 50_000
_NUMBERS = ("limit", "stop", "touch", "trail")
_PRICES = ("open", "high", "low", "close")
_NEVER = 2**62


class _Waiting:
    """Orders of a symbol that wait for their bar.  Each bar is held against all of them at once; those it fills go, the others stay."""

    def __init__(self, price: Callable[[dict[str, np.ndarray], tuple[float, ...]], np.ndarray]):
        self.price, self.new = price, []
        self.ids, self.cols = np.empty(0, object), {}

    def _take(self) -> None:
        """The orders since the last bar join those that wait."""
        ids, side, kind, expires, *numbers = zip(*self.new)
        n = len(ids)
        cols = {"buy": np.array([s == "buy" for s in side]), "type": np.array([k or "" for k in kind], "U12"), "expires": np.array([_NEVER if e is None else e for e in expires], np.int64)}
        cols |= {c: np.array([np.nan if x is None else x for x in v], float) for c, v in zip(_NUMBERS, numbers)}
        cols |= {"latched": np.zeros(n, bool), "best": np.full(n, np.nan)}
        held = np.empty(n, object)
        held[:] = ids
        self.ids, self.new = np.concatenate([self.ids, held]), []
        self.cols = {c: np.concatenate([self.cols[c], v]) for c, v in cols.items()} if self.cols else cols

    def push(self, row):
        us, is_order, *order = row[:-4]
        if is_order:
            self.new.append(order)
            return []
        if self.new:
            self._take()
        if not len(self.ids):
            return []
        if (old := self.cols["expires"] < us).any():
            self._keep(~old)
        price = self.price(self.cols, tuple(np.nan if x is None else x for x in row[-4:]))
        if not (hit := ~np.isnan(price)).any():
            return []
        out = [(i, us, p, row[-1], b) for i, p, b in zip(self.ids[hit].tolist(), price[hit].tolist(), self.cols["buy"][hit].tolist())]
        self._keep(~hit)
        return out

    def _keep(self, which: np.ndarray) -> None:
        self.ids, self.cols = self.ids[which], {c: v[which] for c, v in self.cols.items()}

    def end(self):
        return []


def _wait(orders: DataFrame, bars: DataFrame, price: Callable, value: str) -> DataFrame:
    """order_id, fill_us, a value, the bar's close and whether it buys: orders at the first bar after them for which ``price`` gives a number."""
    parts = orders.where("us IS NOT NULL").groupBy("symbol").agg(F.ceil(F.count("*") / PART_ORDERS).alias("parts"))
    given = {"side": "string", "type": "string", "expires": "bigint"} | dict.fromkeys(_NUMBERS, "double")
    kind = orders.schema["order_id"].dataType.simpleString()
    none = lambda names: [F.lit(None).cast(t).alias(c) for c, t in names.items()]
    o = orders.where("us IS NOT NULL").join(parts, "symbol").select("symbol", F.pmod(F.xxhash64("order_id"), F.col("parts")).alias("part"), "us", F.lit(1).alias("is_order"), "order_id", *[(F.col(c) if c in orders.columns else F.lit(None)).cast(t).alias(c) for c, t in given.items()], *none(dict.fromkeys(_PRICES, "double")))
    b = bars.where("us IS NOT NULL").join(parts, "symbol").select("symbol", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "us", F.lit(0).alias("is_order"), *none({"order_id": kind} | given), *[(F.col(c) if c in bars.columns else F.lit(None)).cast("double").alias(c) for c in _PRICES])
    inputs = ["us", "is_order", "order_id", *given, *_PRICES]
    rows = fold(o.unionByName(b), ["symbol", "part"], ["us", "is_order"], inputs, lambda: _Waiting(price), f"order_id {kind}, fill_us bigint, `{value}` double, close double, buy boolean")
    return rows.select("order_id", "fill_us", value, "close", "buy")


def _fill_price(o: dict[str, np.ndarray], bar: tuple[float, ...]) -> np.ndarray:
    """What each order is filled at by a bar; NaN: not by this one."""
    start, high, low, close = bar
    buy, kind, limit, stop = o["buy"], o["type"], o["limit"], o["stop"]
    broke = np.where(buy, high > stop, low < stop)
    o["latched"] |= np.where(kind == "touched", np.where(buy, low <= o["touch"], high >= o["touch"]), broke)
    capped = np.where(buy, np.fmin(high, limit), np.fmax(low, limit))
    at = {
        "market": close,
        "on_open": start,
        "on_close": close,
        "limit": np.where(np.where(buy, low < limit, high > limit), capped, np.nan),
        "stop": np.where(broke, np.where(buy, np.fmax(stop, close), np.fmin(stop, close)), np.nan),
        "stop_limit": np.where(o["latched"] & np.where(buy, close < limit, close > limit), capped, np.nan),
        "touched": np.where(o["latched"] & np.where(buy, close <= limit, close >= limit), limit, np.nan),
    }
    return np.select([kind == k for k in at], list(at.values()), np.nan)


def fill_orders(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """order_id, fill_us, fill_price: each order filled by the first bar after it that reaches its price, however late.

    ``orders``: order_id (unique), symbol, us, side, type, limit, stop, touch and, if they
    end, expires (us of the last bar that may fill it; null or no such column: none);
    ``bars``: symbol, us (end), open, high, low, close.  Types: market, limit, stop,
    stop_limit (the stop is latched), touched, on_open, on_close.
    """
    return _wait(orders, bars, _fill_price, "fill_price").drop("close", "buy")


def _trailed(o: dict[str, np.ndarray], bar: tuple[float, ...]) -> np.ndarray:
    """Where each stop stands when a bar touches it; NaN: it doesn't.  Closes move the stop for later bars."""
    _, high, low, close = bar
    buy, best = o["buy"], o["best"]
    stop = np.where(buy, np.fmin(o["stop"], best + o["trail"]), np.fmax(o["stop"], best - o["trail"]))
    o["best"] = np.where(buy, np.fmin(best, close), np.fmax(best, close))
    return np.where(np.where(buy, high >= stop, low <= stop), stop, np.nan)


def trailing_fills(orders: DataFrame, bars: DataFrame, slippage: float = 0.0) -> DataFrame:
    """order_id, fill_us, stop, fill_price: a stop that follows the best close so far at the distance ``trail``; it fills on touch, however late.

    The fill is at the stop or, if that is worse, at the bar's close with slippage.
    ``orders`` may have expires, as in ``fill_orders``.
    """
    got = _wait(orders, bars, _trailed, "stop")
    price = F.when(F.col("buy"), F.greatest(F.col("stop"), F.col("close") + slippage)).otherwise(F.least(F.col("stop"), F.col("close") - slippage))
    return got.select("order_id", "fill_us", "stop", price.alias("fill_price"))


def trailing_stops(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """order_id, fill_us, stop: where each trailing stop stands when it is touched."""
    return trailing_fills(orders, bars).drop("fill_price")


def _net(o: dict[str, np.ndarray], bar: tuple[float, ...]) -> np.ndarray:
    return np.where(np.isnan(o["limit"]) | (bar[3] <= o["limit"]), bar[3], np.nan)


def fill_combos(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """combo_id, fill_us, net: legs bought together at the first bar end where all have a bar and the net price is within the limit, however late.

    ``legs``: combo_id, symbol, us, ratio (negative: sold), limit, n_legs and, if they end,
    expires; a null limit takes the first common bar.  Combinations of the same legs share
    one series of net prices, against which they wait as orders do.
    """
    ends = [F.min("expires").alias("expires")] if "expires" in legs.columns else []
    combos = legs.groupBy("combo_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "ratio"))).alias("legs"), F.max("us").alias("us"), F.max("limit").alias("limit"), F.max("n_legs").alias("n_legs"), *ends)
    combos = combos.where(F.size("legs") == F.col("n_legs")).withColumn("key", F.to_json("legs"))
    each = combos.select("key", "legs").dropDuplicates(["key"]).select("key", F.size("legs").alias("n_legs"), F.explode("legs").alias("l")).select("key", "n_legs", "l.*")
    net = each.join(bars.select("symbol", "us", "close"), "symbol").groupBy("key", "us").agg(F.sum(F.col("ratio") * F.col("close")).alias("close"), F.count("*").alias("n"), F.max("n_legs").alias("n_legs")).where("n = n_legs")
    filled = _wait(combos.withColumnsRenamed({"combo_id": "order_id", "key": "symbol"}), net.select(F.col("key").alias("symbol"), "us", "close"), _net, "net")
    return filled.select(F.col("order_id").alias("combo_id"), "fill_us", "net")


def volume_share_slippage(quantity: Column, volume: Column, price: Column, cap: float = 0.025, impact: float = 0.1) -> Column:
    """The square of the share of the bar's volume (at most cap) times impact times price; the cap without volume."""
    share = F.coalesce(F.least(F.abs(quantity) / F.nullif(volume, F.lit(0.0)), F.lit(cap)), F.lit(cap))
    return share * share * impact * price


def fee(quantity: Column, price: Column, rate_bps: float = 0.0, per_unit: float = 0.0, least: float = 0.0, most_share: float | None = None) -> Column:
    """A fee by notional and by unit, at least ``least``, at most a share of the notional."""
    notional = F.abs(quantity * price)
    f = F.greatest(notional * rate_bps / 1e4 + F.abs(quantity) * per_unit, F.lit(least))
    return F.least(f, notional * most_share) if most_share is not None else f


def option_payoff(right: Column, strike: Column, spot: Column) -> Column:
    """What an option is worth at expiry."""
    return F.when(right == "call", F.greatest(spot - strike, F.lit(0.0))).otherwise(F.greatest(strike - spot, F.lit(0.0)))


#: Option strategies as legs: (right or "spot", place of the strike from the lowest 0, units).  Fixed values.
STRATEGIES: Mapping[str, tuple[tuple[str, int, int], ...]] = {
    "naked_call": (("call", 0, -1),),
    "naked_put": (("put", 0, -1),),
    "covered_call": (("spot", 0, 1), ("call", 0, -1)),
    "protective_call": (("spot", 0, -1), ("call", 0, 1)),
    "covered_put": (("spot", 0, -1), ("put", 0, -1)),
    "protective_put": (("spot", 0, 1), ("put", 0, 1)),
    "protective_collar": (("spot", 0, 1), ("put", 0, 1), ("call", 1, -1)),
    "conversion": (("spot", 0, 1), ("put", 0, 1), ("call", 0, -1)),
    "reverse_conversion": (("spot", 0, -1), ("put", 0, -1), ("call", 0, 1)),
    "bull_call_spread": (("call", 0, 1), ("call", 1, -1)),
    "bear_call_spread": (("call", 0, -1), ("call", 1, 1)),
    "bull_put_spread": (("put", 0, 1), ("put", 1, -1)),
    "bear_put_spread": (("put", 0, -1), ("put", 1, 1)),
    "straddle": (("call", 0, 1), ("put", 0, 1)),
    "short_straddle": (("call", 0, -1), ("put", 0, -1)),
    "strangle": (("put", 0, 1), ("call", 1, 1)),
    "short_strangle": (("put", 0, -1), ("call", 1, -1)),
    "butterfly_call": (("call", 0, 1), ("call", 1, -2), ("call", 2, 1)),
    "short_butterfly_call": (("call", 0, -1), ("call", 1, 2), ("call", 2, -1)),
    "butterfly_put": (("put", 0, 1), ("put", 1, -2), ("put", 2, 1)),
    "short_butterfly_put": (("put", 0, -1), ("put", 1, 2), ("put", 2, -1)),
    "iron_butterfly": (("put", 0, 1), ("put", 1, -1), ("call", 1, -1), ("call", 2, 1)),
    "short_iron_butterfly": (("put", 0, -1), ("put", 1, 1), ("call", 1, 1), ("call", 2, -1)),
    "iron_condor": (("put", 0, 1), ("put", 1, -1), ("call", 2, -1), ("call", 3, 1)),
    "short_iron_condor": (("put", 0, -1), ("put", 1, 1), ("call", 2, 1), ("call", 3, -1)),
    "box_spread": (("call", 0, 1), ("put", 0, -1), ("call", 1, -1), ("put", 1, 1)),
    "short_box_spread": (("call", 0, -1), ("put", 0, 1), ("call", 1, 1), ("put", 1, -1)),
    "bear_call_ladder": (("call", 0, -1), ("call", 1, 1), ("call", 2, 1)),
    "bull_call_ladder": (("call", 0, 1), ("call", 1, -1), ("call", 2, -1)),
    "bear_put_ladder": (("put", 2, 1), ("put", 1, -1), ("put", 0, -1)),
    "bull_put_ladder": (("put", 2, -1), ("put", 1, 1), ("put", 0, 1)),
    "call_backspread": (("call", 0, -1), ("call", 1, 2)),
    "put_backspread": (("put", 1, -1), ("put", 0, 2)),
    "short_call_backspread": (("call", 0, 1), ("call", 1, -2)),
    "short_put_backspread": (("put", 1, 1), ("put", 0, -2)),
}


def strategy_payoff(name: str, strikes: list[Column], spot: Column) -> Column:
    """Payoff at expiry of one unit of a strategy, for its strikes from the lowest."""
    out = F.lit(0.0)
    for kind, at, units in STRATEGIES[name]:
        out = out + units * (spot if kind == "spot" else option_payoff(F.lit(kind), strikes[at], spot))
    return out


def active_insights(insights: DataFrame, now: int) -> DataFrame:
    """symbol, active, expired, next_expiry: forecasts (us, expires) that hold at a time, and when the next one ends."""
    open_ = F.col("expires") > now
    return insights.groupBy("symbol").agg(F.count_if((F.col("us") <= now) & open_).alias("active"), F.count_if(~open_).alias("expired"), F.min(F.when(open_, F.col("expires"))).alias("next_expiry"))
