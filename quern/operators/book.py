"""Order books: depth from changes, gaps, snapshots turned into changes, full reconstruction."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.asof import asof
from quern.operators.fold import fold
from quern.operators.running import running_sums
from quern.shards import SHARD_ROWS, ShardPlan, plan_shards

_SUM = "decimal(38,8)"


def effective_deltas(changes: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """changes with delta: how much each adds to the depth of its side; quantities are absolute, a removed level has none.

    A level's history is the partition, not the whole book.
    """
    size = F.when((F.col("action") == "remove") | F.col("quantity").isNull(), 0).otherwise(F.col("quantity")).cast(_SUM)
    w = Window.partitionBy(*keys, "side", "price").orderBy("us", "seq")
    return changes.withColumn("size", size).withColumn("delta", (F.col("size") - F.coalesce(F.lag("size").over(w), F.lit(0))).cast(_SUM))


def running_depth(changes: DataFrame, keys: Sequence[str] = ("symbol",), plan: ShardPlan | None = None) -> DataFrame:
    """changes with bid_depth and ask_depth after each."""
    rows = effective_deltas(changes, keys)
    bid, ask = (F.when(F.col("side") == s, F.col("delta")).otherwise(0).cast(_SUM) for s in ("bid", "ask"))
    return running_sums(rows, keys, "us", ["seq"], {"bid_depth": bid, "ask_depth": ask}, plan)


#: Sequence numbers of one block, within which gaps are looked for by one task.
SEQ_BLOCK = 1_000_000


def sequence_gaps(rows: DataFrame, keys: Sequence[str], seq: str = "seq", block: int = SEQ_BLOCK) -> DataFrame:
    """keys, n_gaps, n_missing: breaks in the numbers of each key, and how many numbers are missing.

    Gaps within blocks of numbers, then those between the last of a block and the first
    of the next, of which there is one a block.  Rows without a number don't count; a key
    that has none has no row.
    """
    ids = rows.where(F.col(seq).isNotNull()).select(*keys, F.col(seq).alias("seq")).distinct().withColumn("block", F.floor(F.col("seq") / block))
    w = Window.partitionBy(*keys, "block").orderBy("seq")
    ids = ids.withColumn("step", F.col("seq") - F.lag("seq").over(w))
    missing = lambda c: F.coalesce(F.sum(F.when(c > 1, c - 1)), F.lit(0))
    inside = ids.groupBy(*keys, "block").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_if(F.col("step") > 1).alias("gaps"), missing(F.col("step")).alias("missing"))
    between = inside.withColumn("step", F.col("lo") - F.lag("hi").over(Window.partitionBy(*keys).orderBy("block")))
    return between.groupBy(*keys).agg((F.sum("gaps") + F.count_if(F.col("step") > 1)).alias("n_gaps"), (F.sum("missing") + missing(F.col("step"))).alias("n_missing"))


def level_changes(levels: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sizes of levels (keys, side, price, us, seq, quantity) as actions: add where the level was empty, modify, remove."""
    w = Window.partitionBy(*keys, "side", "price").orderBy("us", "seq")
    before = F.coalesce(F.lag("quantity").over(w), F.lit(0))
    action = F.when(F.col("quantity") == 0, F.when(before > 0, "remove")).when(before == 0, "add").when(before != F.col("quantity"), "modify")
    return levels.withColumn("action", action).where(F.col("action").isNotNull())


def snapshot_changes(snapshots: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Successive snapshots (keys, us, bids, asks: arrays of price and quantity) as changes: levels that a snapshot lacks are removed."""
    w = Window.partitionBy(*keys).orderBy("us")
    both = snapshots.withColumns({f"{s}_was": F.lag(s).over(w) for s in ("bids", "asks")})
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.map_from_entries(F.col(s)).alias("now"), F.map_from_entries(F.coalesce(F.col(f"{s}_was"), F.slice(s, 1, 0))).alias("was")) for n, s in (("bid", "bids"), ("ask", "asks"))])
    rows = both.select(*keys, "us", F.explode(sides).alias("s")).select(*keys, "us", "s.side", F.explode(F.array_distinct(F.concat(F.map_keys("s.now"), F.map_keys("s.was")))).alias("price"), "s.now", "s.was")
    now, was = F.col("now")[F.col("price")], F.col("was")[F.col("price")]
    action = F.when(now.isNull(), "remove").when(was.isNull(), "add").when(now != was, "modify")
    return rows.select(*keys, "us", "side", "price", F.coalesce(now, F.lit(0)).alias("quantity"), action.alias("action")).where("action IS NOT NULL")


def change_counts(changes: DataFrame, step: int, origin: int = 0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """keys, bucket and for each side how many levels were added, removed and updated within it."""
    over = F.col("us") - F.lit(origin) + F.lit(step - 1)
    bucket = F.greatest(F.lit(origin), F.lit(origin) + (over - F.pmod(over, F.lit(step))))
    names = {"added": "add", "removed": "remove", "updated": "modify"}
    return changes.groupBy(*keys, bucket.alias("bucket")).agg(*[F.count_if((F.col("side") == s) & (F.col("action") == a)).alias(f"{s}_{n}") for s in ("bid", "ask") for n, a in names.items()])


def executed_against_book(trades: DataFrame, quotes: DataFrame, step: int, origin: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """symbol, bucket, bought, sold: notional bought at or above the ask, and sold at or below the bid, that stood just before the trade."""
    facts = quotes.select("symbol", F.col("us").alias("at"), F.col("bid_price").alias("_bid"), F.col("ask_price").alias("_ask"))
    rows = asof(trades, facts, ["symbol"], "us", "at", ["_bid", "_ask"], strict=True, plan=plan_shards(facts, ["symbol"], "at", shard_rows))
    notional = (F.col("price") * F.col("quantity")).cast(_SUM)
    over = F.col("us") - F.lit(origin) + F.lit(step - 1)
    bucket = F.greatest(F.lit(origin), F.lit(origin) + (over - F.pmod(over, F.lit(step))))
    total = lambda c: F.coalesce(F.sum(F.when(c, notional)), F.lit(0)).cast(_SUM)
    return rows.groupBy("symbol", bucket.alias("bucket")).agg(total((F.col("side") == "buy") & (F.col("price") >= F.col("_ask"))).alias("bought"), total((F.col("side") == "sell") & (F.col("price") <= F.col("_bid"))).alias("sold"))


class _Book:
    """Levels of both sides.  Quotes seed the top; changes set or remove levels; state is emitted at bucket ends."""

    def __init__(self, step: int, origin: int, depth: int | None):
        self.step, self.origin, self.depth = step, origin, depth
        self.sides: dict[str, dict[Decimal, Decimal]] = {"bid": {}, "ask": {}}
        self.bucket = None

    def _seed(self, side: str, price, size) -> None:
        """A quote: no level is better than its price, and the level at its price has its size."""
        if price is None or price <= 0:
            return
        levels = self.sides[side]
        for p in [p for p in levels if (p > price if side == "bid" else p < price)]:
            del levels[p]
        if size is not None and size > 0:
            levels[price] = size

    def _row(self) -> tuple:
        bids, asks = self.sides["bid"], self.sides["ask"]
        levels = [[] if self.depth == 0 else [{"price": p, "quantity": v[p]} for p in sorted(v, reverse=v is bids)[: self.depth]] for v in (bids, asks)]
        return (self.bucket, max(bids, default=None), min(asks, default=None), *[sum(v.values(), Decimal(0)) for v in (bids, asks)], len(bids), len(asks), *levels)

    def push(self, row):
        us, kind, side, price, quantity, action, bid, bid_size, ask, ask_size = row
        if kind == "seed":
            self.sides[side][price] = quantity
            return []
        over = max(0, us - self.origin)
        bucket = self.origin + -(-over // self.step) * self.step
        out = []
        if self.bucket is not None and bucket > self.bucket:
            out.append(self._row())
        self.bucket = bucket if self.bucket is None else max(self.bucket, bucket)
        if kind == "quote":
            self._seed("bid", bid, bid_size)
            self._seed("ask", ask, ask_size)
        elif kind == "book" and side in self.sides and price is not None:
            if action == "remove" or not quantity:
                self.sides[side].pop(price, None)
            else:
                self.sides[side][price] = quantity
        return out

    def end(self):
        return [self._row()] if self.bucket is not None else []


def _bucket_shard(step: int, origin: int, per: int) -> Column:
    """The time shard of an event: ``per`` buckets of the grid, closed on the right as these are."""
    over = F.greatest(F.lit(0).cast("bigint"), F.col("us") - origin)
    return F.floor((over + step - 1 - F.pmod(over + F.lit(step - 1), F.lit(step))) / step / per).cast("bigint")


def _seeds(rows: DataFrame, ties: Sequence[str]) -> DataFrame:
    """symbol, shard, side, price, quantity: the levels that rest when a shard begins.

    A level is as its newest change before the shard left it, unless a quote since then
    was worse than its price.  From each shard comes one row for each of its levels, and
    the worst quotes after it; so no task looks at a whole book.
    """
    order = F.struct("us", F.coalesce("seq", F.lit(-(2**62))).alias("seq"), F.coalesce("stream", F.lit(-1)).alias("stream"), *ties)
    size = F.when((F.col("action") == "remove") | F.col("quantity").isNull(), 0).otherwise(F.col("quantity"))
    own = F.when(F.col("kind") == "book", F.array(F.struct("side", "price", size.cast("decimal(18,8)").alias("quantity"))))
    quoted = F.array(*[F.when((F.col(f"{s}_price") > 0) & (F.col(f"{s}_size") > 0), F.struct(F.lit(s).alias("side"), F.col(f"{s}_price").alias("price"), F.col(f"{s}_size").cast("decimal(18,8)").alias("quantity"))) for s in ("bid", "ask")])
    after = Window.partitionBy("symbol", "shard").orderBy(F.col("_order").desc()).rowsBetween(Window.unboundedPreceding, -1)
    worst = {s: F.when((F.col("kind") == "quote") & (F.col(f"{s}_price") > 0), F.col(f"{s}_price")) for s in ("bid", "ask")}
    rows = rows.withColumn("_order", order).withColumns({"low_bid": F.min(worst["bid"]).over(after), "high_ask": F.max(worst["ask"]).over(after)})
    changes = rows.select("symbol", "shard", "_order", "low_bid", "high_ask", F.explode(F.filter(F.coalesce(own, quoted), lambda x: x["price"].isNotNull() & x["side"].isin("bid", "ask"))).alias("x"))
    last = changes.groupBy("symbol", "x.side", "x.price", "shard").agg(F.max_by(F.struct("x.quantity", "low_bid", "high_ask"), "_order").alias("s"))
    ends = rows.groupBy("symbol").agg(F.max("shard").alias("end"))
    level = Window.partitionBy("symbol", "side", "price").orderBy("shard")
    last = last.withColumn("next", F.lead("shard").over(level)).join(ends, "symbol").where("s.quantity > 0")
    upto = F.coalesce("next", "end")
    held = last.where(upto > F.col("shard")).select("symbol", "side", "price", "s.*", F.col("shard").alias("since"), F.explode(F.sequence(F.col("shard") + 1, upto)).alias("shard"))
    quotes = rows.groupBy("symbol", (F.col("shard") + 1).alias("shard")).agg(F.min(worst["bid"]).alias("q_bid"), F.max(worst["ask"]).alias("q_ask"))
    held = held.join(quotes, ["symbol", "shard"], "left")
    since = Window.partitionBy("symbol", "side", "price", "since").orderBy("shard")
    between = lambda c: F.when(F.col("shard") > F.col("since") + 1, F.col(c))
    low, high = F.least("low_bid", F.min(between("q_bid")).over(since)), F.greatest("high_ask", F.max(between("q_ask")).over(since))
    kept = held.withColumn("kept", F.when(F.col("side") == "bid", F.coalesce(F.col("price") <= low, F.lit(True))).otherwise(F.coalesce(F.col("price") >= high, F.lit(True))))
    return kept.where("kept").select("symbol", "shard", "side", "price", "quantity")


def book_states(events: DataFrame, step: int, origin: int = 0, depth: int | None = None, ties: Sequence[str] = (), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """symbol, bucket, best_bid, best_ask, bid_depth, ask_depth, n_bids, n_asks, bids, asks: the book at the end of each bucket with events.

    bids and asks have all levels, best first, or the best ``depth`` of each side where
    that is given (0: none); all other columns are of the whole book in any case.
    Events are taken by us, seq (missing first) and stream, then by ``ties``, columns of
    theirs.  A book is folded in time shards, each of which begins with the levels that
    rest then, so a busy book is no single task.
    """
    level = "array<struct<price: decimal(18,8), quantity: decimal(18,8)>>"
    inputs = ["us", "kind", "side", "price", "quantity", "action", "bid_price", "bid_size", "ask_price", "ask_size"]
    out = f"bucket bigint, best_bid decimal(18,8), best_ask decimal(18,8), bid_depth decimal(38,8), ask_depth decimal(38,8), n_bids int, n_asks int, bids {level}, asks {level}"
    plan = plan_shards(events, ["symbol"], "us", shard_rows)
    if plan.shards == 1:
        return fold(events, ["symbol"], ["us", "seq", "stream", *ties], inputs, lambda: _Book(step, origin, depth), out)
    rows = events.select("symbol", "seq", "stream", *ties, *inputs).withColumn("shard", _bucket_shard(step, origin, max(1, plan.width // step)))
    first = _seeds(rows, ties).withColumns({"kind": F.lit("seed"), "us": F.lit(-(2**62)).cast("bigint")})
    both = rows.unionByName(first, allowMissingColumns=True)
    return fold(both, ["symbol", "shard"], ["us", "seq", "stream", *ties], inputs, lambda: _Book(step, origin, depth), out).drop("shard")


def with_book(observed: DataFrame, events: DataFrame, step: int, origin: int = 0, ties: Sequence[str] = (), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Observations with book_bids and book_asks: all levels of both sides at each bucket, best first, carried forward; null before the first.

    ``events`` are those of the book: changes, quotes, and snapshots as ``snapshot_changes``.
    """
    states = book_states(events, step, origin, None, ties, shard_rows).select("symbol", F.col("bucket").alias("at"), F.col("bids").alias("book_bids"), F.col("asks").alias("book_asks"))
    return asof(observed, states, ["symbol"], "bucket", "at", ["book_bids", "book_asks"], plan=plan_shards(events, ["symbol"], "us", shard_rows))
