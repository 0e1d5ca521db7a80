"""Fills matched into trades: first in first out, last in first out, flat to flat, flat to reduced."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.fold import fold
from quern.operators.running import running_sums
from quern.shards import SHARD_ROWS, ShardPlan, plan_shards

_TRADE = "entry_us bigint, exit_us bigint, direction int, quantity decimal(18,8), entry_price decimal(18,8), exit_price decimal(18,8), pnl decimal(38,8)"


#: Quantities are whole multiples of this, and lie on a line of such units.
UNIT = 10**8


def positions(fills: DataFrame, keys: Sequence[str], ts: str = "us", seq: str = "seq", plan: ShardPlan | None = None) -> DataFrame:
    """keys, us, seq, price, part (``entry`` or ``exit``), direction (of the position), units, starts (whether it was flat before): fills by what they do to the running position.

    A fill that turns a position over is cut in two: an exit of what was held and an
    entry of the rest.  Fills with a null key or a quantity that is not above 0 don't count.
    """
    keys = list(keys)
    rows = fills.select(*keys, F.col(ts).alias("us"), F.col(seq).alias("seq"), F.col("price").cast("decimal(18,8)").alias("price"), F.when(F.col("side") == "buy", 1).otherwise(-1).alias("sign"), (F.col("quantity").cast("decimal(18,8)") * UNIT).cast("bigint").alias("q"))
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    rows = running_sums(rows.where("q > 0"), keys, "us", ["seq"], {"after": F.col("sign") * F.col("q")}, plan)
    before = F.col("after") - F.col("sign") * F.col("q")
    left = F.when(before * F.col("sign") < 0, F.least(F.abs(before), F.col("q"))).otherwise(0)
    parts = F.array(F.struct(F.lit("exit").alias("part"), (-F.col("sign")).alias("direction"), left.cast("bigint").alias("units"), F.lit(False).alias("starts")), F.struct(F.lit("entry").alias("part"), F.col("sign").alias("direction"), (F.col("q") - left).cast("bigint").alias("units"), ((before == 0) | (left > 0)).alias("starts")))
    return rows.select(*keys, "us", "seq", "price", F.explode(F.filter(parts, lambda p: p["units"] > 0)).alias("p")).select(*keys, "us", "seq", "price", "p.*")


def match_fifo(fills: DataFrame, keys: Sequence[str], ts: str = "us", seq: str = "seq", plan: ShardPlan | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Trades first in first out: keys, entry_us, entry_seq, exit_us, exit_seq, direction, quantity, entry_price, exit_price, pnl.

    All units entered lie on one line in order of time, all units left on another.  As a
    position is flat before it turns, the n-th unit that leaves is the n-th that came in,
    so the lines of both are cut at each other's ends, and each piece belongs to the entry
    and the exit that end at or after it.  Pieces are found by sorting the ends, in shards
    of the line; no pairs are made.  Units still held have no row.
    """
    keys = list(keys)
    parts = positions(fills, keys, ts, seq, plan)
    parts = running_sums(parts, [*keys, "part"], "us", ["seq"], {"at": F.col("units")}, plan)
    of = lambda part: F.max(F.when(F.col("part") == part, F.struct("us", "seq", "price", "direction"))).alias(part)
    cuts = parts.groupBy(*keys, "at").agg(of("entry"), of("exit"))
    line = plan_shards(cuts, keys, "at", shard_rows)
    cuts = cuts.withColumn("shard", line.of(F.col("at")))
    back = Window.partitionBy(*keys, "shard").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cuts = cuts.withColumns({c: F.last(c, True).over(back) for c in ("entry", "exit")} | {"from": F.lag("at").over(Window.partitionBy(*keys, "shard").orderBy("at"))})
    if line.shards > 1:
        ends = cuts.groupBy(*keys, "shard").agg(F.max("at").alias("_from"), *[F.min_by(c, "at").alias(f"_{c}") for c in ("entry", "exit")])
        later = Window.partitionBy(*keys).orderBy(F.col("shard").desc()).rowsBetween(Window.unboundedPreceding, -1)
        earlier = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "shard", F.max("_from").over(earlier).alias("_from"), *[F.last(f"_{c}", True).over(later).alias(f"_{c}") for c in ("entry", "exit")])
        cuts = cuts.join(ends, [*keys, "shard"]).withColumns({c: F.coalesce(c, f"_{c}") for c in ("entry", "exit", "from")})
    both = cuts.where(F.col("entry").isNotNull() & F.col("exit").isNotNull())
    units = (F.col("at") - F.coalesce("from", F.lit(0))).cast("decimal(28,0)")
    both = both.withColumn("quantity", (units / UNIT).cast("decimal(18,8)"))
    pnl = ((F.col("exit.price") - F.col("entry.price")) * F.col("quantity") * F.col("entry.direction")).cast("decimal(38,8)")
    return both.select(*keys, F.col("entry.us").alias("entry_us"), F.col("entry.seq").alias("entry_seq"), F.col("exit.us").alias("exit_us"), F.col("exit.seq").alias("exit_seq"), F.col("entry.direction").alias("direction"), "quantity", F.col("entry.price").alias("entry_price"), F.col("exit.price").alias("exit_price"), pnl.alias("pnl"))


def flat_trades(fills: DataFrame, keys: Sequence[str], ts: str = "us", seq: str = "seq", plan: ShardPlan | None = None) -> DataFrame:
    """One trade from flat to flat: keys, entry_us, exit_us, direction, quantity, entry_cost, exit_cost, pnl.

    A position that turns ends one trade and starts the next with the rest of the fill.
    Positions that are open at the end have no row.
    """
    keys = list(keys)
    parts = positions(fills, keys, ts, seq, plan).withColumn("step", F.when(F.col("part") == "exit", 0).otherwise(1))
    parts = running_sums(parts, keys, "us", ["seq", "step"], {"span": F.col("starts").cast("bigint")}, plan)
    own = lambda part, x: F.sum(F.when(F.col("part") == part, x))
    cost = (F.col("price") * (F.col("units").cast("decimal(20,0)") / UNIT).cast("decimal(18,8)")).cast("decimal(38,8)")
    g = parts.groupBy(*keys, "span").agg(F.min("us").alias("entry_us"), F.max("us").alias("exit_us"), F.max("direction").alias("direction"), own("entry", F.col("units")).alias("came"), F.coalesce(own("exit", F.col("units")), F.lit(0)).alias("left"), own("entry", cost).alias("entry_cost"), own("exit", cost).alias("exit_cost"))
    g = g.where("came = left")
    return g.select(*keys, "entry_us", "exit_us", "direction", (F.col("came").cast("decimal(28,0)") / UNIT).cast("decimal(28,8)").alias("quantity"), "entry_cost", "exit_cost", ((F.col("exit_cost") - F.col("entry_cost")) * F.col("direction")).cast("decimal(38,8)").alias("pnl"))


def reduced_trades(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One trade for each fill that reduces a position, from the rows of ``match_fifo``: entered at the mean price of the units that left (``entry_cost``: at all of them)."""
    keys = list(keys)
    q = F.sum("quantity")
    g = matched.groupBy(*keys, "exit_us", "exit_seq").agg(F.min("entry_us").alias("entry_us"), F.max("direction").alias("direction"), q.cast("decimal(28,8)").alias("quantity"), (F.sum(F.col("entry_price") * F.col("quantity")).cast("double") / q.cast("double")).alias("entry_price"), F.sum(F.col("entry_price") * F.col("quantity")).cast("decimal(38,8)").alias("entry_cost"), F.max("exit_price").alias("exit_price"), F.sum("pnl").cast("decimal(38,8)").alias("pnl"))
    return g.select(*keys, "entry_us", "exit_us", "exit_seq", "direction", "quantity", "entry_price", "entry_cost", "exit_price", "pnl")


class _Lots:
    """Open lots; a closing fill takes the newest (or the oldest) first, what is left of it opens the other way."""

    def __init__(self, newest: bool):
        self.newest, self.lots = newest, []

    def push(self, row):
        us, side, price, q = row
        sign, out = (1 if side == "buy" else -1), []
        while q > 0 and self.lots and self.lots[0][1] == -sign:
            lot = self.lots[-1 if self.newest else 0]
            part = min(q, lot[3])
            out.append((lot[0], us, lot[1], part, lot[2], price, (price - lot[2]) * part * lot[1]))
            lot[3] -= part
            q -= part
            if not lot[3]:
                self.lots.remove(lot)
        if q > 0:
            self.lots.append([us, sign, price, q])
        return out

    def end(self):
        return []


class _Flat:
    """One trade from flat to flat, or with ``reduced`` one for each fill that reduces; entries at their mean."""

    def __init__(self, reduced: bool):
        self.reduced, self.reset = reduced, None
        self._clear()

    def _clear(self):
        self.us, self.sign, self.held, self.cost, self.out_q, self.out_cost = None, 0, Decimal(0), Decimal(0), Decimal(0), Decimal(0)

    def _trade(self, us, q, exit_cost):
        entry = self.cost / self.held if self.reduced else self.cost / self.total
        leave = exit_cost / q
        return (self.us, us, self.sign, q, round(entry, 8), round(leave, 8), round((leave - entry) * q * self.sign, 8))

    def push(self, row):
        us, side, price, q = row
        sign, out = (1 if side == "buy" else -1), []
        if self.held == 0:
            self._clear()
            self.us, self.sign, self.total = us, sign, Decimal(0)
        if sign == self.sign:
            self.held, self.cost, self.total = self.held + q, self.cost + q * price, self.total + q
            return out
        part = min(q, self.held)
        if self.reduced:
            out.append(self._trade(us, part, part * price))
            self.cost -= self.cost / self.held * part
        else:
            self.out_q, self.out_cost = self.out_q + part, self.out_cost + part * price
        self.held -= part
        if self.held == 0:
            if not self.reduced:
                out.append(self._trade(us, self.out_q, self.out_cost))
            if q > part:
                self._clear()
                self.us, self.sign, self.held, self.cost, self.total = us, sign, q - part, (q - part) * price, q - part
        return out

    def end(self):
        return []


def match_fills(fills: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Trades by ``lifo``, ``fifo``, ``flat`` (to flat) or ``reduced``; fills have us, seq, side, price, quantity."""
    start = {"lifo": lambda: _Lots(True), "fifo": lambda: _Lots(False), "flat": lambda: _Flat(False), "reduced": lambda: _Flat(True)}[how]
    rows = fills.select(*keys, "us", "seq", "side", F.col("price").cast("decimal(18,8)").alias("price"), F.col("quantity").cast("decimal(18,8)").alias("quantity")).where("quantity > 0")
    return fold(rows, keys, ["us", "seq"], ["us", "side", "price", "quantity"], start, _TRADE)
