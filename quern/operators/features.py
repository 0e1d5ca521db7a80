"""Features of observations: a registry of named builders of columns.

A builder gets the feature's parameters and returns a column over the observation's
columns and the features it needs.  Whatever a job does not name is never computed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.running import block_window, in_blocks, own_rows
from quern.shards import SHARD_ROWS, ShardPlan

#: Rows of history that a rolling feature may look back.
HISTORY = 1000


def _d(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def by_time() -> Window:
    """The one window of all features: rows of a symbol in order of bucket, in blocks (see ``feature_rows``)."""
    return block_window(["symbol"])


@dataclass(frozen=True)
class Feature:
    """name; builder from parameters; features it needs; defaults of its parameters; how its column is called."""

    name: str
    build: Callable[[dict[str, float]], Column]
    needs: tuple[str, ...] = ()
    defaults: tuple[tuple[str, float], ...] = ()
    label: Callable[[dict[str, float]], str] | None = None
    about: str = ""
    #: Rows before its own that it looks at, from its parameters.
    back: Callable[[dict[str, float]], int] = lambda p: 0


REGISTRY: dict[str, Feature] = {}


def register(name: str, build: Callable[[dict[str, float]], Column], needs: tuple[str, ...] = (), label=None, about: str = "", back: Callable[[dict[str, float]], int] | None = None, **defaults: float) -> None:
    """Add a feature, one's own as well; names are compared without regard to case.

    One that looks at rows before its own says how many (``back``) and uses ``by_time``.
    """
    REGISTRY[name.lower()] = Feature(name.lower(), build, needs, tuple(defaults.items()), label, about, back or (lambda p: 0))


def _mid() -> Column:
    both = (F.col("bid_price") > 0) & (F.col("ask_price") > 0)
    return F.when(F.coalesce(both, F.lit(False)), (_d("bid_price") + _d("ask_price")) / 2).otherwise(_d("last"))


def _spread() -> Column:
    both = (F.col("bid_price") > 0) & (F.col("ask_price") > 0)
    return F.when(F.coalesce(both, F.lit(False)), _d("ask_price") - _d("bid_price")).otherwise(0.0)


def _side_depth(side: str) -> Column:
    return F.when(F.col(f"{side}_price") > 0, _d(f"{side}_size")).otherwise(0.0)


def _levels(side: str) -> Column:
    """price and quantity of a side's levels, best first; without book data (``book.with_book``) those of the top of the book."""
    book = F.transform(f"book_{side}s", lambda x: F.struct(x["price"].cast("double").alias("p"), x["quantity"].cast("double").alias("q")))
    one = F.when((F.col(f"{side}_price") > 0) & (F.col(f"{side}_size") > 0), F.array(F.struct(_d(f"{side}_price").alias("p"), _d(f"{side}_size").alias("q"))))
    return F.coalesce(book, one, F.array().cast("array<struct<p: double, q: double>>"))


def _sum(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["q"])


def _in_band(bps: float) -> tuple[Column, Column]:
    bids = F.filter("bids", lambda x: x["p"] >= F.col("mid_price") * (1 - bps / 1e4))
    asks = F.filter("asks", lambda x: x["p"] <= F.col("mid_price") * (1 + bps / 1e4))
    return _sum(bids), _sum(asks)


def _structural(p: dict[str, float]) -> Column:
    b, a = _in_band(p["bps"])
    return _ratio(b - a, b + a)


def _wall(p: dict[str, float]) -> Column:
    """Distance in basis points of the nearest level above mult times the mean; 0 without one."""
    levels = F.concat("bids", "asks")
    mean = _sum(levels) / F.size(levels)
    far = F.transform(F.filter(levels, lambda x: x["q"] > p["mult"] * mean), lambda x: F.abs(x["p"] - F.col("mid_price")) / F.col("mid_price") * 1e4)
    return F.when((F.size(levels) >= 3) & (F.col("mid_price") > 0), F.coalesce(F.array_min(far), F.lit(0.0))).otherwise(0.0)


def _resistance(p: dict[str, float]) -> Column:
    mean = _sum(F.col("asks")) / F.size("asks")
    above = F.transform(F.filter("asks", lambda x: (x["q"] > p["factor"] * mean) & (x["p"] > F.col("mid_price"))), lambda x: x["p"])
    return F.when((F.size("asks") >= 2) & (F.col("mid_price") > 0), F.coalesce((F.array_min(above) - F.col("mid_price")) / F.col("mid_price") * 1e4, F.lit(0.0))).otherwise(0.0)


def _depletion(p: dict[str, float]) -> Column:
    """Depth in the band now less that of L + 1 rows back (or the oldest there is); 0 while there is one row of history."""
    b, a = _in_band(p["bps"])
    w, now = by_time(), b + a
    back = F.coalesce(F.lag(now, int(p["lookback"]) + 1).over(w), F.first(now).over(w.rowsBetween(-HISTORY, 0)))
    return F.when(F.col("_rank") > 2, now - back).otherwise(0.0)


def _replenishment(p: dict[str, float]) -> Column:
    b, a = _in_band(p["bps"])
    w = by_time().rowsBetween(-int(p["window"]), -1)
    n = F.count(F.lit(1)).over(w)
    return F.when(n >= 2, (F.last(b + a).over(w) - F.first(b + a).over(w)) / n).otherwise(0.0)


def _persistence(p: dict[str, float]) -> Column:
    w, d = by_time().rowsBetween(-int(p["window"]), -1), F.col("depth")
    mean = F.avg(d).over(w)
    return F.when(F.count(d).over(w) < 2, 1.0).when(mean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop(d).over(w) / mean))


def _flow() -> Column:
    return (F.col("aggressive_buy_volume") - F.col("aggressive_sell_volume")).cast("double")


register("mid_price", lambda p: _mid(), about="mean of bid and ask, else the last price")
register("spread", lambda p: _spread())
register("spread_bps", lambda p: F.when(F.col("mid_price") > 0, F.col("spread") / F.col("mid_price") * 1e4).otherwise(0.0), ("mid_price", "spread"))
register("trade_flow", lambda p: _flow(), about="notional bought less notional sold")
register("net_flow", lambda p: _flow())
register("aggressive_buy_volume", lambda p: F.col("aggressive_buy_volume").cast("double"))
register("aggressive_sell_volume", lambda p: F.col("aggressive_sell_volume").cast("double"))
register("cumulative_flow", lambda p: F.col("cumulative_flow").cast("double"), about="running signed quantity")
register("trade_intensity", lambda p: F.col("trade_count").cast("double"))
register("trade_volume", lambda p: F.col("trade_volume").cast("double"))
register("bid_depth", lambda p: _sum(F.col("bids")), ("bids",))
register("ask_depth", lambda p: _sum(F.col("asks")), ("asks",))
register("depth", lambda p: F.col("bid_depth") + F.col("ask_depth"), ("bid_depth", "ask_depth"))
register("imbalance", lambda p: _ratio(F.col("bid_depth") - F.col("ask_depth"), F.col("depth")), ("depth",))
register("depth_ratio", lambda p: _ratio(F.col("bid_depth"), F.col("ask_depth")), ("bid_depth", "ask_depth"))
register("structural_imbalance", _structural, ("mid_price", "bids", "asks"), lambda p: f"structural_imbalance_{p['bps']:g}bps", bps=10)
register("liquidity_wall", _wall, ("mid_price", "bids", "asks"), lambda p: f"liquidity_wall_{p['mult']:g}x", mult=3)
register("resistance", _resistance, ("mid_price", "asks"), lambda p: f"resistance_{p['factor']:g}x", factor=2)
register("liquidity_depletion", _depletion, ("mid_price", "bids", "asks"), None, "", lambda p: max(HISTORY, int(p["lookback"]) + 1), lookback=5, bps=10)
register("replenishment_rate", _replenishment, ("mid_price", "bids", "asks"), None, "", lambda p: int(p["window"]), window=10, bps=10)
register("depth_persistence", _persistence, ("depth",), None, "", lambda p: int(p["window"]), window=20)
register("bids", lambda p: _levels("bid"), about="levels of the bid side, best first")
register("asks", lambda p: _levels("ask"))

#: Raw fields by name: what an observation itself says, 0 where it says nothing.
RAW: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
    "symbol": (lambda: F.col("symbol"), ()),
    "timestamp": (lambda: F.timestamp_micros("bucket"), ()),
    "mid_price": (lambda: F.col("mid_price"), ("mid_price",)),
    "bid_price": (lambda: _d("bid_price"), ()),
    "ask_price": (lambda: _d("ask_price"), ()),
    "last_price": (lambda: _d("last"), ()),
    "spread": (lambda: F.col("spread"), ("spread",)),
    "spread_bps": (lambda: F.col("spread_bps"), ("spread_bps",)),
    "depth": (lambda: F.col("depth"), ("depth",)),
    "bid_depth": (lambda: F.col("bid_depth"), ("bid_depth",)),
    "ask_depth": (lambda: F.col("ask_depth"), ("ask_depth",)),
    "volume": (lambda: _d("trade_volume"), ()),
    "trade_count": (lambda: F.col("trade_count"), ()),
    "vwap": (lambda: _ratio(_d("notional"), _d("trade_volume")), ()),
    "open_price": (lambda: _d("open_at"), ()),
    "high_price": (lambda: _d("high_at"), ()),
    "low_price": (lambda: _d("low_at"), ()),
    "close_price": (lambda: _d("close_at"), ()),
    "trade_flow": (lambda: _flow(), ()),
}


def resolve(names: Mapping[str, object] | list[str] | tuple[str, ...]) -> list[str]:
    """The features and all they need, each after what it needs."""
    out: list[str] = []
    open_: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        if n in open_:
            raise ValueError("features need each other: " + " -> ".join([*open_[open_.index(n) :], n]))
        if n not in REGISTRY:
            raise ValueError(f"no feature {n!r}")
        open_.append(n)
        for m in REGISTRY[n].needs:
            visit(m)
        open_.pop()
        out.append(n)

    for n in names:
        visit(n.lower())
    return out


def _parameters(f: Feature, given: Mapping[str, str]) -> dict[str, float]:
    out = dict(f.defaults)
    for k, v in given.items():
        if k in out:
            try:
                out[k] = float(v)
            except ValueError:
                pass  # a parameter that isn't a number leaves the default
    return out


def feature_rows(observed: DataFrame, features: Mapping[str, Mapping[str, str]], raw_fields: tuple[str, ...] = (), keep: tuple[str, ...] = (), plan: ShardPlan | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """symbol, bucket, data_quality, data_age_ms, ``keep``, then features and raw fields; a feature hides a raw field of its name.

    Features that look back get blocks of rows with as many before them as they need, so
    no task holds a symbol.  ``plan``: shards of the buckets, if they are known (one pass
    over the observations otherwise).
    """
    names = resolve([*features, *[n for r in raw_fields for n in RAW[r][1]]])
    labels, rows = {}, observed
    for c in ("book_bids", "book_asks"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("array<struct<price: decimal(18,8), quantity: decimal(18,8)>>"))
    back = max((REGISTRY[n].back(_parameters(REGISTRY[n], features.get(n, {}))) for n in names), default=0)
    if back:
        rows = in_blocks(rows, ["symbol"], "bucket", [], before=back, plan=plan, rows=shard_rows)
    for n in names:
        p = _parameters(REGISTRY[n], features.get(n, {}))
        labels[n] = REGISTRY[n].label(p) if REGISTRY[n].label else n
        rows = rows.withColumn(n, REGISTRY[n].build(p))
    rows = own_rows(rows) if back else rows
    fixed = ["symbol", "bucket", "data_quality", "data_age_ms", *keep]
    raw = [RAW[r][0]().alias(r) for r in raw_fields if r not in fixed and r not in [labels[n] for n in features]]
    return rows.select(*fixed, *[F.col(n).alias(labels[n]) for n in features], *raw)


def catalog(spark: SparkSession) -> DataFrame:
    """All measurements: name, kind, what they need."""
    rows = [(f.name, "feature", ",".join(f.needs), f.about) for f in REGISTRY.values()] + [(r, "raw", ",".join(n), "") for r, (_, n) in RAW.items()]
    return spark.createDataFrame(rows, "name string, kind string, needs string, about string")
