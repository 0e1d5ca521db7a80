"""A paper account, and the experiments that trade on observations.

The account is plain Python over ``Decimal`` and knows nothing of Spark; experiments
run it in a fold over each symbol's observations and emit rows tagged by table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.fold import fold
from quern.plans.job import Condition

_CENT, _TICK, ZERO = Decimal("1E-8"), Decimal("1E-10"), Decimal(0)


def money(x: Decimal) -> Decimal:
    return x.quantize(_CENT, ROUND_HALF_UP)


def price_of(x) -> Decimal:
    return Decimal(str(x)).quantize(_TICK, ROUND_HALF_UP)


@dataclass
class Account:
    """Cash and one position for each symbol; ``fills``, ``trades`` and ``curve`` grow as it trades."""

    cash: Decimal = Decimal(100_000)
    fee_bps: Decimal = ZERO
    units: dict[str, Decimal] = field(default_factory=dict)
    entry: dict[str, Decimal] = field(default_factory=dict)
    marks: dict[str, Decimal] = field(default_factory=dict)
    opened: dict[str, tuple] = field(default_factory=dict)
    realized: Decimal = ZERO
    fees: Decimal = ZERO
    peak: Decimal | None = None
    max_drawdown: Decimal = ZERO
    fills: list[dict] = field(default_factory=list)
    trades: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.start = self.cash
        self.peak = self.cash

    def unrealized(self) -> Decimal:
        return sum((self.units[s] * (self.marks[s] - self.entry[s]) for s in self.units if self.units[s]), ZERO)

    def value(self) -> Decimal:
        return sum((q * self.marks[s] for s, q in self.units.items() if q), ZERO)

    def equity(self) -> Decimal:
        return self.cash + self.value()

    def target(self, symbol: str, units: Decimal, price: Decimal, at, reason: str = "") -> None:
        """Trade to a number of units.  Through zero it is two fills: one closes, one opens."""
        now = self.units.get(symbol, ZERO)
        self.marks[symbol] = price
        if now and units and (now > 0) != (units > 0):
            self.target(symbol, ZERO, price, at, reason)
            now = ZERO
        change = units - now
        if not change:
            return
        fee = money(abs(change) * price * self.fee_bps / 10_000)
        gain = ZERO
        if now and abs(units) < abs(now):
            gain = money((price - self.entry[symbol]) * -change)
        else:
            self.entry[symbol] = price_of((self.entry.get(symbol, ZERO) * now + price * change) / units)
        if not now:
            self.opened[symbol] = (at, price, self.realized, self.fees, units)
        self.realized += gain
        self.fees += fee
        self.cash = money(self.cash - change * price - fee)
        self.units[symbol] = units
        self.fills.append({"at": at, "symbol": symbol, "quantity": change, "price": price, "fee": fee, "realized": gain, "reason": reason})
        if not units:
            when, first, before, paid, size = self.opened.pop(symbol)
            pnl, fees = self.realized - before, self.fees - paid
            self.trades.append({"symbol": symbol, "side": "long" if size > 0 else "short", "entry_at": when, "exit_at": at, "entry": first, "exit": price, "quantity": abs(size), "pnl": pnl, "fees": fees})

    def fraction(self, symbol: str, share: Decimal, price: Decimal) -> Decimal:
        """Units that a share of the equity buys."""
        return money(self.equity() * share / price) if price > 0 else ZERO

    def mark(self, symbol: str, price: Decimal) -> dict:
        """Value the account at a price: one point of its curve."""
        self.marks[symbol] = price
        e = self.equity()
        self.peak = max(self.peak, e)
        down = (self.peak - e) / self.peak if self.peak > 0 else ZERO
        self.max_drawdown = max(self.max_drawdown, down)
        gross = sum((abs(q * self.marks[s]) for s, q in self.units.items()), ZERO)
        return {"cash": self.cash, "equity": e, "unrealized": self.unrealized(), "realized": self.realized, "drawdown": down, "exposure": gross}

    def liquidate(self, at, reason: str = "end") -> None:
        for s in [s for s, q in self.units.items() if q]:
            self.target(s, ZERO, self.marks[s], at, reason)

    def metrics(self) -> dict[str, float]:
        wins = [t for t in self.trades if t["pnl"] > 0]
        return {"ending_equity": float(self.equity()), "total_return": float(self.equity() / self.start - 1), "realized_pnl": float(self.realized), "max_drawdown": float(self.max_drawdown), "total_fees": float(self.fees), "fill_count": len(self.fills), "trade_count": len(self.trades), "win_rate": len(wins) / len(self.trades) if self.trades else 0.0}


_ROWS = "kind string, at bigint, quantity double, price double, value double, fees double, reason string"


def _emit(account: Account, seen: list[int]) -> list[tuple]:
    """Fills and trades since the last call."""
    out = [("fill", f["at"], float(f["quantity"]), float(f["price"]), float(f["realized"]), float(f["fee"]), f["reason"]) for f in account.fills]
    out += [("trade", t["exit_at"], float(t["quantity"]), float(t["exit"]), float(t["pnl"]), float(t["fees"]), t["side"]) for t in account.trades]
    seen[0] += len(account.fills)
    seen[1] += len(account.trades)
    account.fills, account.trades = [], []
    return out


class _Position:
    """Enter when flat and the condition holds; leave on the exit condition (after the least hold) or after the longest."""

    def __init__(self, share: Decimal, fee_bps: Decimal, least: int, most: int | None, short: bool):
        self.share, self.least, self.most, self.short = share, least, most, short
        self.account, self.since, self.seen = Account(fee_bps=fee_bps), None, [0, 0]

    def push(self, row):
        at, price, enters, leaves = row
        if price is None or not price > 0:
            return []
        p, held = price_of(price), self.account.units.get("x", ZERO)
        if held:
            age = at - self.since
            if (leaves and age >= self.least) or (self.most is not None and age >= self.most):
                self.account.target("x", ZERO, p, at, "exit" if leaves and age >= self.least else "time")
        elif enters:
            units = self.account.fraction("x", self.share, p)
            self.account.target("x", -units if self.short else units, p, at, "entry")
            self.since = at
        point = self.account.mark("x", p)
        return [*_emit(self.account, self.seen), ("equity", at, float(self.account.units.get("x", ZERO)), float(p), float(point["equity"]), float(self.account.fees), "")]

    def end(self):
        return []


def position_experiment(rows: DataFrame, config: Mapping[str, str], price: str = "close") -> DataFrame:
    """Tagged rows (fill, trade, equity) of a position taken by conditions; ``rows``: symbol, bucket, ``price`` and what conditions name.

    config: entry, exit (conditions), fraction, fee_bps, min_hold, max_hold (microseconds), side.
    """
    enter = Condition.parse(config["entry"]).column(rows.columns)
    leave = Condition.parse(config["exit"]).column(rows.columns) if config.get("exit") else F.lit(False)
    share, bps = Decimal(config.get("fraction", "0.1")), Decimal(config.get("fee_bps", "0"))
    least, most = int(config.get("min_hold", 0)), int(config["max_hold"]) if config.get("max_hold") else None
    short = config.get("side", "long") == "short"
    ready = rows.select("symbol", F.col("bucket").alias("at"), F.col(price).cast("double").alias("price_"), enter.alias("enters"), leave.alias("leaves"))
    return fold(ready, ["symbol"], ["at"], ["at", "price_", "enters", "leaves"], lambda: _Position(share, bps, least, most, short), _ROWS)


def parse_order(order) -> tuple[str, Decimal] | None:
    """What a script returned: None, a side, or a mapping with side/action and size/quantity/units or fraction/weight.

    A size that is missing means all of it for closing, and the strategy's share for opening.
    """
    if order is None:
        return None
    if isinstance(order, str):
        order = {"side": order}
    side = str(order.get("side", order.get("action", order.get("signal", "")))).strip().lower()
    side = {"long": "buy", "b": "buy", "enter": "buy", "short": "sell", "s": "sell", "exit": "close", "flat": "close", "none": "hold", "": "hold"}.get(side, side)
    if side not in ("buy", "sell", "close", "hold"):
        raise ValueError(f"not an order: {order!r}")
    if side == "hold":
        return None
    for name in ("units", "quantity", "size", "qty"):
        if name in order:
            x = float(order[name])
            if not math.isfinite(x) or x < 0:
                raise ValueError(f"not a size: {order!r}")
            return side, Decimal(str(x))
    return side, Decimal(-1)


def order_share(order) -> Decimal | None:
    """The fraction or weight of an order: of equity when opening, of what is held when closing; None without one."""
    if not isinstance(order, dict):
        return None
    for name in ("fraction", "weight"):
        if name in order:
            x = float(order[name])
            if not math.isfinite(x) or not 0 <= x <= 1:
                raise ValueError(f"not a share: {order!r}")
            return Decimal(str(x))
    return None


class _Script:
    """Runs a strategy's hooks in order over one symbol and trades what it returns."""

    def __init__(self, make: Callable[[], object], names: tuple[str, ...], share: Decimal, fee_bps: Decimal, trades: bool):
        self.strategy, self.names, self.share, self.trading = make(), names, share, trades
        self.account, self.seen, self.last = Account(fee_bps=fee_bps), [0, 0], None
        self._call("initialize")

    def _call(self, hook: str, *args):
        f = getattr(self.strategy, hook, None)
        return f(*args) if f else None

    def _rows(self, at: int, got) -> list[tuple]:
        if not isinstance(got, dict):
            return []
        out = []
        for k, v in got.items():
            x = float(v)
            if not math.isfinite(x):
                raise ValueError(f"{k} is not finite")
            out.append(("value", at, 0.0, 0.0, x, 0.0, str(k)))
        return out

    def push(self, row):
        payload = dict(zip(self.names, row))
        at, price = payload["bucket"], payload["price"]
        got = self._call("on_observation", payload)
        if not self.trading:
            return self._rows(at, got)
        if price is None or not price > 0:
            return []
        p, order = price_of(price), parse_order(got)
        self.last = (at, p)
        if order:
            side, size = order
            share = order_share(got) if size < 0 else None
            held = self.account.units.get("x", ZERO)
            if share is not None:
                size = abs(held) * share if side == "close" else self.account.fraction("x", share, p)
            if side == "close":
                self.account.target("x", ZERO if size < 0 else held - (size if held > 0 else -size), p, at, "close")
            else:
                size = self.account.fraction("x", self.share, p) if size < 0 else size
                self.account.target("x", held + (size if side == "buy" else -size), p, at, side)
        point = self.account.mark("x", p)
        return [*_emit(self.account, self.seen), ("equity", at, float(self.account.units.get("x", ZERO)), float(p), float(point["equity"]), float(self.account.fees), "")]

    def end(self):
        out = self._rows(0, self._call("finalize")) if not self.trading else []
        if self.trading and self.last:
            self.account.liquidate(self.last[0])
            out += _emit(self.account, self.seen)
        return out


def run_strategy(rows: DataFrame, make: Callable[[], object], fields: tuple[str, ...], price: str = "close", trade: bool = False, fraction: str = "0.1", fee_bps: str = "0") -> DataFrame:
    """Tagged rows of a strategy: an object with any of initialize(), on_observation(payload), finalize().

    The payload has symbol, bucket, price and ``fields``.  With ``trade`` the hook returns
    orders, else a mapping of values, which are emitted as they are.
    """
    names = ("symbol", "bucket", "price", *fields)
    ready = rows.select("symbol", "bucket", F.col(price).cast("double").alias("price"), *[f for f in fields if f not in ("symbol", "bucket", "price")])
    share, bps = Decimal(fraction), Decimal(fee_bps)
    return fold(ready, ["symbol"], ["bucket"], names, lambda: _Script(make, names, share, bps, trade), _ROWS)


def composite(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several experiments in one table, tagged by ``experiment``; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("experiment", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
