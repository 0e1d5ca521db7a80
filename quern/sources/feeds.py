"""Readers: staged feeds, frame archives, raw daily files, synthetic events."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.events import PRICE, conform, unified

#: Columns of the staged CSV files, in order.  Fixed values.
FILES = {
    "bars": ("timestamp_ms", "open", "high", "low", "close", "volume"),
    "trades": ("timestamp_ms", "price", "size", "side", "trade_id"),
    "quotes": ("timestamp_ms", "bid_price", "bid_size", "ask_price", "ask_size"),
    "book_updates": ("timestamp_ms", "side", "price", "quantity", "action"),
}
#: Raw files give prices of these asset classes in ten-thousandths.  Fixed values.
SCALED = ("equity", "option", "indexoption")


def _number(c: str) -> Column:
    """A decimal, 0 where the text is none."""
    return F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS {PRICE})"), F.lit(0).cast(PRICE))


def staged_csv(spark: SparkSession, path: str, kind: str, folders: Sequence[str] = ()) -> DataFrame:
    """One staged file (or a folder or pattern of them); lines without a time are skipped.

    ``folders``: names of the levels of folders below ``path`` (as in symbol=X/venue=Y),
    which become columns; filters on them read only the folders that match.
    """
    names = FILES[kind]
    raw = spark.read.schema(", ".join(f"{c} string" for c in (*names, *folders))).option("header", True).option("mode", "PERMISSIVE").csv(path)
    out = raw.withColumn("timestamp_ms", F.expr("try_cast(trim(timestamp_ms) AS bigint)")).where(F.col("timestamp_ms").isNotNull())
    texts = ("side", "trade_id", "action")
    return out.select(*folders, "timestamp_ms", *[F.trim(c).alias(c) if c in texts else _number(c).alias(c) for c in names[1:]])


def feed_events(rows: DataFrame, kind: str, symbol: Column, venue: Column, stream: int = 0, seq: Column | str = "timestamp_ms", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a staged file, or of a table of its columns, as events; seq is the time, as such feeds have it, unless another is given."""
    us, base = F.col("timestamp_ms") * 1000, {"symbol": symbol, "venue": venue, "seq": seq, "keep": keep}
    if kind == "trades":
        side = F.lower("side")
        return conform(rows, "trade", stream, us=us, price="price", quantity="size", side=F.when(side.isin("buy", "sell"), side).otherwise("unknown"), **base)
    if kind == "quotes":
        return conform(rows, "quote", stream, us=us, bid_price="bid_price", bid_size="bid_size", ask_price="ask_price", ask_size="ask_size", **base)
    if kind == "bars":
        return conform(rows, "bar", stream, us=us, open="open", high="high", low="low", close="close", quantity="volume", **base)
    return conform(rows, "book", stream, us=us, side=F.lower("side"), price="price", quantity="quantity", action=F.coalesce(F.lower("action"), F.lit("add")), **base)


def staged_events(spark: SparkSession, folder: str, symbol: str, venue: str, kinds: Sequence[str] = ("trades", "quotes")) -> DataFrame:
    """All asked-for files of one symbol's folder, merged; the place in ``kinds`` breaks ties."""
    files = {"bars": "bars_*.csv", "trades": "trades.csv", "quotes": "quotes.csv", "book_updates": "book_updates.csv"}
    return unified([feed_events(staged_csv(spark, f"{folder}/{files[k]}", k), k, F.lit(symbol), F.lit(venue), i) for i, k in enumerate(kinds)])


def same_symbol(a: Column, b: Column) -> Column:
    """Tickers are equal whatever their case and separators."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_/]", "")
    return plain(a) == plain(b)


def staged_bounds(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.count("*").alias("n"))


def frame_archive(lines: DataFrame, column: str = "value") -> DataFrame:
    """Archived frames, one JSON line each ({"a": arrival, "f": frame}), as level rows.

    symbol, us, kind (snapshot or delta), update_id, side, price, quantity; lines that
    are no frames give none.
    """
    frame = "struct<a: bigint, f: struct<type: string, ts: bigint, data: struct<s: string, u: bigint, b: array<array<string>>, a: array<array<string>>>>>"
    rows = lines.select(F.from_json(column, frame).alias("x")).where("x.f.data IS NOT NULL")

    def side(name: str, s: str) -> Column:
        pairs = F.coalesce(F.col(f"x.f.data.{name}"), F.array().cast("array<array<string>>"))
        return F.transform(pairs, lambda v: F.struct(F.lit(s).alias("side"), v[0].cast(PRICE).alias("price"), v[1].cast(PRICE).alias("quantity")))

    levels = F.concat(side("b", "bid"), side("a", "ask"))
    return rows.select(F.col("x.f.data.s").alias("symbol"), (F.col("x.f.ts") * 1000).alias("us"), F.col("x.f.type").alias("kind"), F.col("x.f.data.u").alias("update_id"), F.explode(levels).alias("l")).select("symbol", "us", "kind", "update_id", "l.*")


def raw_bars(lines: DataFrame, asset_class: str, daily: bool, date: Column, column: str = "value") -> DataFrame:
    """Lines of raw files: ``ms of the day`` (or ``yyyyMMdd HH:mm`` if daily), open, high, low, close, volume."""
    p = F.split(column, ",")
    scale = F.lit(10_000.0 if asset_class in SCALED else 1.0)
    at = F.to_timestamp(p[0], "yyyyMMdd HH:mm") if daily else F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + p[0].cast("bigint") * 1000)
    return lines.where(F.size(p) >= 6).select(at.alias("ts"), *[(F.expr(f"try_cast(split({column}, ',')[{i}] AS double)") / scale).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)], F.expr(f"try_cast(split({column}, ',')[5] AS double)").alias("volume"))


_PATH = re.compile(r"^(?P<asset>[^/]+)/(?P<market>[^/]+)/(?P<resolution>[^/]+)/(?P<symbol>[^/]+)/(?P<date>\d{8})_(?P<tick>\w+)\.\w+$")


def data_path(asset: str, market: str, resolution: str, symbol: str, date: str, tick: str) -> str:
    return f"{asset}/{market}/{resolution}/{symbol.lower()}/{date}_{tick}.zip"


def parse_path(path: str) -> dict[str, str] | None:
    m = _PATH.match(path)
    return m.groupdict() if m else None


def with_path_fields(df: DataFrame, path: Column) -> DataFrame:
    """df with asset, market, resolution, symbol, date and tick of its file's path."""
    rx = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/(\d{8})_(\w+)\.\w+$"
    return df.withColumns({n: F.regexp_extract(path, rx, i) for i, n in enumerate(("asset", "market", "resolution", "ticker", "date", "tick"), 1)})


def synthetic_events(spark: SparkSession, n: int, symbols: int = 4, start_us: int = 1_704_067_200_000_000, seed: int = 1) -> DataFrame:
    """n events, a trade and a quote by turns, one a millisecond; prices from hashes of the number, so any part can be made anywhere."""
    i = F.col("id")
    h = lambda k: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(10_000))
    mid = (F.lit(100) + F.round(F.sin(i / 5000.0) * 5, 2) + h(1) / 100_000.0).cast(PRICE)
    trade = i % 2 == 0
    half = F.lit("0.01").cast(PRICE)
    rows = spark.range(n)
    out = conform(rows, "trade", 0, symbol=F.concat(F.lit("S"), i % symbols), venue=F.lit("synthetic"), us=F.lit(start_us) + i * 1000, seq=i, price=F.when(trade, mid), quantity=F.when(trade, 1 + h(2) % 9), side=F.when(trade, F.when(h(3) % 2 == 0, "buy").otherwise("sell")), bid_price=F.when(~trade, mid - half), bid_size=F.when(~trade, 1 + h(4) % 5), ask_price=F.when(~trade, mid + half), ask_size=F.when(~trade, 1 + h(5) % 5))
    return out.withColumn("kind", F.when(F.col("price").isNotNull(), "trade").otherwise("quote"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """What a data folder holds: for each asset class, market, resolution, ticker and tick type its dates, files and bytes.

    Only names and sizes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rows = with_path_fields(files, F.col("path")).where(F.col("date") != "")
    return rows.groupBy("asset", "market", "resolution", "ticker", "tick").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def bar_file(names: Sequence[str], seconds: int) -> str | None:
    """The bars file of a resolution, else the first there is, by name."""
    bars = sorted(n for n in names if re.fullmatch(r"bars_\d+\.csv", n))
    exact = f"bars_{seconds}.csv"
    return exact if exact in bars else bars[0] if bars else None


def open_source(spark: SparkSession, source: dict, kinds: Sequence[str] = ("trades", "quotes")) -> DataFrame:
    """Events of a source descriptor: mode ``feed`` (a staged folder), ``archive`` (frames), ``table`` (Parquet of events), ``synthetic``."""
    mode = source.get("mode", "feed")
    if mode == "feed":
        return staged_events(spark, source["path"], source["symbol"], source.get("venue", ""), kinds)
    if mode == "archive":
        rows = frame_archive(spark.read.text(source["path"]))
        return conform(rows, "book", 0, symbol="symbol", venue=F.lit(source.get("venue", "")), us="us", seq="update_id", side="side", price="price", quantity="quantity", action=F.when(F.col("quantity") == 0, "remove").otherwise("modify"))
    if mode == "table":
        return spark.read.parquet(source["path"])
    if mode == "synthetic":
        return synthetic_events(spark, int(source.get("events", 1000)))
    raise ValueError(f"no source of mode {mode!r}")
