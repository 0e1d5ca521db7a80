"""Queries of bars, rolling windows, performance and trade matching, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import bars as b
from quern.operators import matching as m
from quern.operators import rolling_stats as r
from quern.operators.running import islands
from quern.plans.q_grid import HOUR, TRADES, QUOTES, quotes, trades
from quern.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 24 * HOUR


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


_OHLC = "CAST(arg_min(price, (us, seq)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (us, seq)) AS DOUBLE) AS close, CAST(sum(quantity) AS DOUBLE) AS volume, count(*) AS n"
_BAR = ("open", "high", "low", "close", "volume")


@query("time_bars", f"WITH {TRADES} SELECT symbol, us - us % {DAY} AS bar, {_OHLC} FROM t GROUP BY 1, 2")
def time_bars(spark, d):
    return doubles(b.time_bars(trades(spark, d), DAY), *_BAR)


@query("sequential_bars", f"WITH {TRADES} SELECT symbol, us - us % {DAY} AS bar, {_OHLC} FROM t GROUP BY 1, 2")
def sequential_bars(spark, d):
    """Daily bars from hourly ones from ticks."""
    return doubles(b.merge_bars(b.time_bars(trades(spark, d), HOUR), DAY), *_BAR)


@query("count_bars", f"WITH {TRADES}, p AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY us, seq) - 1) // 10 AS bar FROM t) SELECT symbol, bar, {_OHLC}, min(us) AS start_us, max(us) AS end_us FROM p GROUP BY 1, 2 HAVING count(*) = 10")
def count_bars(spark, d):
    return doubles(b.count_bars(trades(spark, d), 10), *_BAR)


def _calendar(unit):
    return lambda spark, d: doubles(b.calendar_bars(trades(spark, d), unit), *_BAR)


for _unit in ("week", "month", "quarter", "year"):
    QUERIES[f"calendar_bars_{_unit}"] = _calendar(_unit)
    SQL[f"calendar_bars_{_unit}"] = f"WITH {TRADES} SELECT symbol, CAST(date_trunc('{_unit}', make_timestamp(us)) AS DATE) AS bar, {_OHLC} FROM t GROUP BY 1, 2"


@query("quote_bars_prev_close", f"""WITH {QUOTES}, g AS (
  SELECT symbol, us - us % {DAY} AS bar, CAST(arg_min(bid_price, (us, seq)) AS DOUBLE) AS bo, CAST(max(bid_price) AS DOUBLE) AS bh, CAST(min(bid_price) AS DOUBLE) AS bl, CAST(arg_max(bid_price, (us, seq)) AS DOUBLE) AS bc,
         CAST(arg_min(ask_price, (us, seq)) AS DOUBLE) AS ao, CAST(max(ask_price) AS DOUBLE) AS ah, CAST(min(ask_price) AS DOUBLE) AS al, CAST(arg_max(ask_price, (us, seq)) AS DOUBLE) AS ac FROM q GROUP BY 1, 2
), l AS (SELECT *, lag(bc) OVER w AS pb, lag(ac) OVER w AS pa FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar))
SELECT symbol, bar, coalesce(pb, bo) AS bid_open, greatest(bh, pb) AS bid_high, least(bl, pb) AS bid_low, bc AS bid_close, coalesce(pa, ao) AS ask_open, greatest(ah, pa) AS ask_high, least(al, pa) AS ask_low, ac AS ask_close FROM l""")
def quote_bars_prev_close(spark, d):
    return doubles(b.quote_bars(quotes(spark, d), DAY), *[f"{s}_{x}" for s in ("bid", "ask") for x in ("open", "high", "low", "close")])


_QUOTE_SIDES = [(s, x) for s in ("bid", "ask") for x in ("open", "high", "low", "close")]


@query("sequential_quote_bars", f"""WITH {QUOTES}, g AS (SELECT symbol, us - us % {HOUR} AS bar, """ + ", ".join(f"CAST(arg_min({s}_price, (us, seq)) AS DOUBLE) AS {s}_open, CAST(max({s}_price) AS DOUBLE) AS {s}_high, CAST(min({s}_price) AS DOUBLE) AS {s}_low, CAST(arg_max({s}_price, (us, seq)) AS DOUBLE) AS {s}_close" for s in ("bid", "ask")) + f""" FROM q GROUP BY 1, 2),
l AS (SELECT *, lag(bid_close) OVER w AS bid_was, lag(ask_close) OVER w AS ask_was FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
h AS (SELECT symbol, bar, """ + ", ".join(f"coalesce({s}_was, {s}_open) AS {s}_open, greatest({s}_high, {s}_was) AS {s}_high, least({s}_low, {s}_was) AS {s}_low, {s}_close" for s in ("bid", "ask")) + f""" FROM l),
d AS (SELECT symbol, bar - bar % {DAY} AS day, """ + ", ".join(f"arg_min({s}_open, bar) AS {s}_open, max({s}_high) AS {s}_high, min({s}_low) AS {s}_low, arg_max({s}_close, bar) AS {s}_close" for s in ("bid", "ask")) + """ FROM h GROUP BY 1, 2),
m AS (SELECT *, lag(bid_close) OVER w AS bid_was, lag(ask_close) OVER w AS ask_was FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day AS bar, """ + ", ".join(f"coalesce({s}_was, {s}_open) AS {s}_open, greatest({s}_high, {s}_was) AS {s}_high, least({s}_low, {s}_was) AS {s}_low, {s}_close" for s in ("bid", "ask")) + " FROM m")
def sequential_quote_bars(spark, d):
    """Daily quote bars from hourly ones."""
    return doubles(b.merge_quote_bars(b.quote_bars(quotes(spark, d), HOUR), DAY), *[f"{s}_{x}" for s, x in _QUOTE_SIDES])


@query("oi_last", f"WITH {TRADES} SELECT symbol, us - us % {DAY} AS bar, CAST(arg_max(quantity, (us, seq)) AS DOUBLE) AS quantity FROM t GROUP BY 1, 2")
def oi_last(spark, d):
    return doubles(b.last_values(trades(spark, d), DAY, "quantity"), "quantity")


def _bricks_sql(amount: str, size: int) -> str:
    return f"""WITH {TRADES}, c AS (SELECT *, {amount} AS v, sum({amount}) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS u FROM t WHERE {amount} > 0),
x AS (SELECT c.*, k.bar FROM c, unnest(range(CAST(floor((u - v) / {size}) AS BIGINT), CAST(ceil(u / {size}) AS BIGINT))) AS k(bar))
SELECT symbol, bar, CAST(arg_min(price, (us, seq)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (us, seq)) AS DOUBLE) AS close,
       round(CAST(sum(least(u, (bar + 1) * {size}) - greatest(u - v, bar * {size})) AS DOUBLE), 6) AS volume, count(*) AS n FROM x GROUP BY 1, 2"""


@query("volume_renko", _bricks_sql("quantity", 25))
def volume_renko(spark, d):
    return doubles(b.volume_bricks(trades(spark, d), 25), *_BAR).withColumn("volume", F.round("volume", 6))


@query("dollar_renko", _bricks_sql("price * quantity", 500))
def dollar_renko(spark, d):
    return doubles(b.volume_bricks(trades(spark, d), 500, of=F.col("price") * F.col("quantity")), *_BAR).withColumn("volume", F.round("volume", 6))


@query("session_bars", f"WITH {TRADES}, s AS (SELECT *, CAST(make_timestamp(us) AS DATE) AS bar FROM t WHERE dayofweek(make_timestamp(us)) BETWEEN 1 AND 5 AND us % {DAY} >= {int(9.5 * HOUR)} AND us % {DAY} < {16 * HOUR}) SELECT symbol, bar, {_OHLC} FROM s GROUP BY 1, 2")
def session_bars(spark, d):
    hours = spark.createDataFrame([(w, int(9.5 * HOUR), 16 * HOUR) for w in range(2, 7)], "weekday int, open_us bigint, close_us bigint")
    return doubles(b.session_bars(trades(spark, d), hours), *_BAR)


#: Prices as whole cents in order, for the recursions below: each step takes one tick of every symbol.
_TICKS = f"{TRADES}, n AS (SELECT symbol, us, row_number() OVER (PARTITION BY symbol ORDER BY us, seq) AS i, CAST(round(price * 100) AS BIGINT) AS p, quantity AS q FROM t)"
_BRICKS = "SELECT symbol, us, open / 100.0::DOUBLE AS open, high / 100.0::DOUBLE AS high, low / 100.0::DOUBLE AS low, close / 100.0::DOUBLE AS close, direction"


def _wicked_sql(size: int) -> str:
    """s: the lattice point, trend and extremes after each tick, and the k bricks that it closes from base on."""
    return f"""WITH RECURSIVE {_TICKS}, s AS (
  SELECT symbol, i, us, CAST(CASE WHEN p % {size} * 2 > {size} THEN p - p % {size} + {size} ELSE p - p % {size} END AS BIGINT) AS pos, 0 AS trend, CAST(CASE WHEN p % {size} * 2 > {size} THEN p - p % {size} + {size} ELSE p - p % {size} END AS BIGINT) AS top,
         CAST(CASE WHEN p % {size} * 2 > {size} THEN p - p % {size} + {size} ELSE p - p % {size} END AS BIGINT) AS bottom, 0::BIGINT AS k, 0::BIGINT AS base, 0 AS way, 0::BIGINT AS wick FROM n WHERE i = 1
  UNION ALL
  SELECT symbol, i, us, CASE WHEN k > 0 THEN base + way * k * {size} ELSE pos END, CASE WHEN k > 0 THEN way ELSE trend END, CASE WHEN k > 0 AND way < 0 THEN base - k * {size} ELSE top END, CASE WHEN k > 0 AND way > 0 THEN base + k * {size} ELSE bottom END, k, base, way, CASE WHEN way > 0 THEN bottom ELSE top END
  FROM (SELECT *, greatest((p - base) * way - 1, 0) // {size} AS k FROM (
    SELECT n.symbol, n.i, n.us, n.p, s.pos, s.trend, greatest(s.top, n.p) AS top, least(s.bottom, n.p) AS bottom, CAST(sign(n.p - s.pos) AS INT) AS way, CAST(CASE WHEN s.trend = -sign(n.p - s.pos) AND s.trend <> 0 THEN s.pos + sign(n.p - s.pos) * {size} ELSE s.pos END AS BIGINT) AS base
    FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1))
), e AS (
  SELECT symbol, us, base + way * j * {size} AS open, base + way * (j + 1) * {size} AS close, CASE WHEN j = 0 THEN wick ELSE base + way * j * {size} END AS w, way AS direction FROM s, unnest(range(0, k)) AS x(j)
), b AS (SELECT symbol, us, open, CASE WHEN direction > 0 THEN close ELSE w END AS high, CASE WHEN direction > 0 THEN w ELSE close END AS low, close, direction FROM e)
{_BRICKS} FROM b"""


def _classic_sql(size: int) -> str:
    return f"""WITH RECURSIVE {_TICKS}, s AS (
  SELECT symbol, i, us, CAST((p + {size} - 1) // {size} * {size} AS BIGINT) AS open, CAST((p + {size} - 1) // {size} * {size} AS BIGINT) AS hi, CAST((p + {size} - 1) // {size} * {size} AS BIGINT) AS lo, false AS shut, 0::BIGINT AS o0, 0::BIGINT AS h0, 0::BIGINT AS l0, 0::BIGINT AS c0 FROM n WHERE i = 1
  UNION ALL
  SELECT symbol, i, us, CASE WHEN abs(p - open) >= {size} THEN c ELSE open END, CASE WHEN abs(p - open) >= {size} THEN c ELSE greatest(hi, c) END, CASE WHEN abs(p - open) >= {size} THEN c ELSE least(lo, c) END, abs(p - open) >= {size}, open, greatest(hi, c), least(lo, c), c
  FROM (SELECT n.symbol, n.i, n.us, n.p, s.open, s.hi, s.lo, least(s.open + {size}, greatest(s.open - {size}, n.p)) AS c FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1)
), b AS (SELECT symbol, us, o0 AS open, h0 AS high, l0 AS low, c0 AS close, CASE WHEN c0 > o0 THEN 1 ELSE -1 END AS direction FROM s WHERE shut)
{_BRICKS} FROM b"""


def _range_sql(size: int, classic: bool = False) -> str:
    """s: the bar after each tick (of one cent), and the k bars that it closes: the one there was, and empty ones after it."""
    nxt = "p" if classic else f"CASE WHEN up THEN lo + {size} + 1 + (k - 1) * {size + 1} ELSE hi - {size} - 1 - (k - 1) * {size + 1} END"
    more = "1" if classic else f"1 + CASE WHEN up THEN greatest(p - (lo + {size} + 1) - {size} + {size}, 0) // {size + 1} ELSE greatest((hi - {size} - 1) - p - {size} + {size}, 0) // {size + 1} END"
    return f"""WITH RECURSIVE {_TICKS}, s AS (
  SELECT symbol, i, us, CAST((p + {size} - 1) // {size} * {size} AS BIGINT) AS open, CAST((p + {size} - 1) // {size} * {size} AS BIGINT) AS hi, CAST((p + {size} - 1) // {size} * {size} AS BIGINT) AS lo, CAST(q AS BIGINT) AS volume, 0::BIGINT AS k, 0::BIGINT AS o0, 0::BIGINT AS h0, 0::BIGINT AS l0, 0::BIGINT AS v0, true AS up FROM n WHERE i = 1
  UNION ALL
  SELECT symbol, i, us, CASE WHEN k > 0 THEN nxt ELSE open END, CASE WHEN k > 0 THEN greatest(nxt, p) ELSE greatest(hi, p) END, CASE WHEN k > 0 THEN least(nxt, p) ELSE least(lo, p) END, CASE WHEN k > 0 THEN q ELSE volume + q END, k, open, hi, lo, volume, up
  FROM (SELECT *, CAST({nxt} AS BIGINT) AS nxt FROM (SELECT *, CAST(CASE WHEN NOT over THEN 0 ELSE {more} END AS BIGINT) AS k FROM (
    SELECT n.symbol, n.i, n.us, n.p, CAST(n.q AS BIGINT) AS q, s.open, s.hi, s.lo, s.volume, n.p > s.hi AS up, CASE WHEN n.p > s.hi THEN n.p - s.lo ELSE s.hi - n.p END > {size} AS over FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1)))
), e AS (
  SELECT symbol, us, up, CASE WHEN j = 0 THEN o0 WHEN up THEN l0 + {size} + 1 + (j - 1) * {size + 1} ELSE h0 - {size} - 1 - (j - 1) * {size + 1} END AS open,
         CASE WHEN up THEN l0 + j * {size + 1} ELSE h0 - j * {size + 1} END AS near, CASE WHEN j = 0 THEN v0 ELSE 0 END AS volume FROM s, unnest(range(0, k)) AS x(j)
), b AS (SELECT symbol, us, open, CASE WHEN up THEN near + {size} ELSE near END AS high, CASE WHEN up THEN near ELSE near - {size} END AS low, CASE WHEN up THEN near + {size} ELSE near - {size} END AS close, CASE WHEN up THEN 1 ELSE -1 END AS direction, CAST(volume AS DOUBLE) AS volume FROM e)
{_BRICKS}, volume FROM b"""


_MIXED_SQL = f"""WITH RECURSIVE {_TICKS}, s AS (
  SELECT symbol, i, us - us % {DAY} AS bar, p AS open, p AS hi, p AS lo, p AS c, 1 AS n, false AS late, 0::BIGINT AS b0, 0::BIGINT AS o0, 0::BIGINT AS h0, 0::BIGINT AS l0, 0::BIGINT AS c0, 0 AS n0 FROM n WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.i, CASE WHEN fresh THEN n.us - n.us % {DAY} ELSE bar END, CASE WHEN fresh THEN n.p ELSE open END, CASE WHEN fresh THEN n.p ELSE greatest(hi, n.p) END, CASE WHEN fresh THEN n.p ELSE least(lo, n.p) END, n.p, CASE WHEN fresh THEN 1 ELSE n + 1 END, n < 5 AND fresh, bar, open, hi, lo, c, n
  FROM (SELECT *, s.n = 5 AS full_bar FROM s) s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1, LATERAL (SELECT s.full_bar OR n.us >= s.bar + {DAY} AS fresh)
), b AS (
  SELECT symbol, bar, open, hi, lo, c, n FROM s WHERE n = 5
  UNION ALL SELECT symbol, b0, o0, h0, l0, c0, n0 FROM s WHERE late
)
SELECT symbol, bar, open / 100.0::DOUBLE AS open, hi / 100.0::DOUBLE AS high, lo / 100.0::DOUBLE AS low, c / 100.0::DOUBLE AS close, n FROM b"""


@query("wicked_renko", _wicked_sql(500))
def wicked_renko(spark, d):
    return doubles(b.renko_bars(trades(spark, d), "5"), "open", "high", "low", "close")


@query("classic_renko", _classic_sql(500))
def classic_renko(spark, d):
    return doubles(b.renko_bars(trades(spark, d), "5", classic=True), "open", "high", "low", "close")


@query("range_bars", _range_sql(1000))
def range_bars(spark, d):
    return doubles(b.range_bars(trades(spark, d), "10"), *_BAR)


@query("classic_range_bars", _range_sql(1000, classic=True))
def classic_range_bars(spark, d):
    return doubles(b.range_bars(trades(spark, d), "10", classic=True), *_BAR)


@query("mixed_bars", _MIXED_SQL)
def mixed_bars(spark, d):
    return doubles(b.mixed_bars(trades(spark, d), 5, DAY), "open", "high", "low", "close")


# ---- rolling windows


def daily(spark: SparkSession, d: str) -> DataFrame:
    """symbol, bar, close of each user's days."""
    return b.time_bars(trades(spark, d), DAY).select("symbol", "bar", F.col("close").cast("double").alias("close"))


_DAILY = f"{TRADES}, y AS (SELECT symbol, us - us % {DAY} AS bar, CAST(arg_max(price, (us, seq)) AS DOUBLE) AS close FROM t GROUP BY 1, 2)"
def _w() -> Window:
    return r.over(["symbol"], ["bar"])


@query("rolling_sma", f"WITH {_DAILY} SELECT symbol, bar, round(CASE WHEN count(*) OVER w >= 5 THEN avg(close) OVER w END, 8) AS sma FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING)")
def rolling_sma(spark, d):
    return daily(spark, d).select("symbol", "bar", F.round(r.moving_average("close", 5, _w()), 8).alias("sma"))


@query("pct_change", f"WITH {_DAILY} SELECT symbol, bar, round(close / nullif(lag(close) OVER w, 0) - 1, 8) AS change FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar)")
def pct_change(spark, d):
    return daily(spark, d).select("symbol", "bar", F.round(r.percent_change("close", _w()), 8).alias("change"))


_RET = f"{_DAILY}, z AS (SELECT symbol, bar, close, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar))"


@query("rolling_volatility", f"WITH {_RET} SELECT symbol, bar, round(CASE WHEN count(ret) OVER w < 2 THEN 0 ELSE stddev_samp(ret) OVER w * sqrt(252) END, 6) AS volatility, round(stddev_samp(close) OVER w / nullif(avg(close) OVER w, 0), 6) AS relative FROM z WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 9 PRECEDING)")
def rolling_volatility(spark, d):
    rows = daily(spark, d).withColumn("ret", r.percent_change("close", _w()))
    return rows.select("symbol", "bar", F.round(r.rolling_volatility("ret", 10, _w()), 6).alias("volatility"), F.round(r.relative_deviation("close", 10, _w()), 6).alias("relative"))


@query("rolling_history", f"WITH {_DAILY} SELECT symbol, bar, list(close) OVER w AS closes FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)".replace("list(close) OVER w", "coalesce(list(close) OVER w, [])"))
def rolling_history(spark, d):
    return daily(spark, d).withColumn("h", r.history(["close"], 3, _w())).select("symbol", "bar", F.transform("h", lambda x: x["close"]).alias("closes"))


_CURVE = "c AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"


def curve(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))


@query("drawdown_recovery", f"WITH {_CURVE}, p AS (SELECT *, max(v) OVER w AS peak FROM c WINDOW w AS (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)) SELECT k, day, peak, round((peak - v) / peak, 8) AS drawdown, last_value(CASE WHEN v = peak THEN day END IGNORE NULLS) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak_at FROM p")
def drawdown_recovery(spark, d):
    return r.drawdowns(curve(spark, d), "v", ["k"], "day").select("k", "day", "peak", F.round("drawdown", 8).alias("drawdown"), "peak_at")


@query("drawdown_metrics", f"WITH {_CURVE}, p AS (SELECT *, max(v) OVER w AS peak FROM c WINDOW w AS (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, last_value(CASE WHEN v = peak THEN day END IGNORE NULLS) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS held FROM p), l AS (SELECT *, lag(v) OVER w AS v0, lag(peak) OVER w AS p0, lag(held) OVER w AS a0 FROM q WINDOW w AS (PARTITION BY k ORDER BY day)) SELECT k, round(max((peak - v) / peak), 6) AS max_drawdown, CAST(coalesce(max(CASE WHEN v0 < p0 AND v >= p0 THEN date_diff('day', a0, day) END), 0) AS INT) AS max_recovery_days FROM l GROUP BY 1")
def drawdown_metrics(spark, d):
    return r.drawdown_metrics(curve(spark, d), "v", ["k"], "day", 6)


@query("compound_annual", f"WITH {_CURVE}, e AS (SELECT k, arg_min(v, day) AS a, arg_max(v, day) AS b, date_diff('day', min(day), max(day)) / 365.25 AS years FROM c GROUP BY 1) SELECT k, round(coalesce(pow(b / nullif(a, 0), 1.0 / nullif(years, 0)) - 1, 0), 8) AS growth FROM e")
def compound_annual(spark, d):
    g = curve(spark, d).groupBy("k").agg(F.min_by("v", "day").alias("a"), F.max_by("v", "day").alias("b"), (F.date_diff(F.max("day"), F.min("day")) / 365.25).alias("years"))
    return g.select("k", F.round(r.compound_annual(F.col("a"), F.col("b"), F.col("years")), 8).alias("growth"))


@query("win_streaks", f"WITH {_RET}, f AS (SELECT *, ret > 0 AS flag FROM z WHERE ret IS NOT NULL), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - row_number() OVER (PARTITION BY symbol, flag ORDER BY bar) AS isl FROM f), h AS (SELECT symbol, flag, isl, count(*) AS length FROM g GROUP BY 1, 2, 3) SELECT symbol, flag, max(length) AS longest, count(*) AS n FROM h GROUP BY 1, 2")
def win_streaks(spark, d):
    rows = daily(spark, d).withColumn("ret", r.percent_change("close", _w())).where("ret IS NOT NULL")
    return r.streaks(rows, F.col("ret") > 0, ["symbol"], ["bar"]).groupBy("symbol", "flag").agg(F.max("length").alias("longest"), F.count("*").alias("n"))


_CRET = f"{_CURVE}, e AS (SELECT *, v / nullif(lag(v) OVER (PARTITION BY k ORDER BY day), 0) - 1 AS ret FROM c)"


def _returns(spark, d):
    return curve(spark, d).withColumn("ret", r.percent_change("v", r.over(["k"], ["day"])) / 100)


_SAFE = "coalesce({a} / nullif({b}, 0), 0)"
_ANNUAL = "pow(avg(ret / 100) + 1, 252) - 1"
_DEV = "sqrt(coalesce(var_samp(ret / 100), 0) * 252)"
_DOWN = "sqrt(coalesce(var_samp(ret / 100) FILTER (ret < 0), 0) * 252)"


@query("sharpe_sortino", f"WITH {_CRET} SELECT k, round({_ANNUAL}, 6) AS annual_return, round(coalesce(var_samp(ret / 100), 0) * 252, 6) AS annual_variance, round({_DEV}, 6) AS annual_deviation, round({_DOWN}, 6) AS downside_deviation, round(({_ANNUAL}) / nullif({_DEV}, 0), 6) AS sharpe, round(({_ANNUAL}) / nullif({_DOWN}, 0), 6) AS sortino FROM e GROUP BY 1")
def sharpe_sortino(spark, d):
    out = _returns(spark, d).groupBy("k").agg(*r.performance("ret"))
    return out.select("k", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("parametric_var", f"WITH {_CRET} SELECT k, round(avg(ret / 100) - 1.6448536269514722 * stddev_samp(ret / 100), 8) AS var_95, round(avg(ret / 100) - 2.3263478740408408 * stddev_samp(ret / 100), 8) AS var_99 FROM e GROUP BY 1")
def parametric_var(spark, d):
    return _returns(spark, d).groupBy("k").agg(F.round(r.value_at_risk("ret", r.Z95), 8).alias("var_95"), F.round(r.value_at_risk("ret", r.Z99), 8).alias("var_99"))


@query("beta_alpha_te", f"WITH {_CRET}, p AS (SELECT e.k, e.ret / 100 AS ret, x.ret / 100 AS bench FROM e JOIN e x ON e.day = x.day AND x.k = '1-URGENT' WHERE e.ret IS NOT NULL AND x.ret IS NOT NULL) SELECT k, round(covar_samp(ret, bench) / nullif(var_samp(bench), 0), 6) AS beta, round(sqrt(coalesce(var_samp(ret - bench), 0) * 252), 6) AS tracking_error, round((pow(avg(ret) + 1, 252) - 1) - covar_samp(ret, bench) / nullif(var_samp(bench), 0) * (pow(avg(bench) + 1, 252) - 1), 6) AS alpha FROM p GROUP BY 1")
def beta_alpha_te(spark, d):
    rows = _returns(spark, d).where("ret IS NOT NULL")
    bench = rows.where("k = '1-URGENT'").select("day", F.col("ret").alias("bench"))
    out = rows.join(bench, "day").groupBy("k").agg(*r.against_benchmark("ret", "bench"))
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("beta", "tracking_error", "alpha")])


_PROB_SHARPE = f"""WITH {_CRET}, g AS (SELECT k, count(ret) AS n, avg(ret / 100) AS m, stddev_samp(ret / 100) AS s, skewness(ret / 100) AS g1, kurtosis(ret / 100) AS g2 FROM e WHERE ret IS NOT NULL GROUP BY 1),
u AS (SELECT *, m / s AS sharpe, 1 - g1 * (m / s) + (g2 + 2) / 4 * (m / s) * (m / s) AS under FROM g WHERE n > 3 AND s > 0), z AS (SELECT *, sharpe * sqrt(n - 1) / sqrt(under) AS z FROM u WHERE under > 0),
t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
f AS (SELECT *, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS erf FROM t)
SELECT k, n, round(sharpe, 8) AS sharpe, round(CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END, 6) AS probability FROM f"""


@query("prob_sharpe", _PROB_SHARPE)
def prob_sharpe(spark, d):
    return r.probabilistic_sharpe(_returns(spark, d), "ret", ["k"]).withColumns({"sharpe": F.round("sharpe", 8), "probability": F.round("probability", 6)})


@query("group_adjacent", f"WITH {TRADES}, c AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY symbol ORDER BY us, seq) THEN 0 ELSE 1 END AS x FROM t), g AS (SELECT *, sum(x) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS isl FROM c) SELECT symbol, min(side) AS side, min(us) AS first, max(us) AS last, count(*) AS length FROM g GROUP BY symbol, isl")
def group_adjacent(spark, d):
    return islands(trades(spark, d), ["symbol"], "us", ["seq"], "side")


# ---- trades


def fills(spark: SparkSession, d: str) -> DataFrame:
    """Adapter D: each supplier's lines as fills; returned ones sell."""
    rows = table(spark, d, "lineitem")
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.select(F.col("l_suppkey").alias("symbol"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), (seq * 1_000_000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10_000 + 0.5) / 10_000).cast("decimal(18,4)").cast("decimal(18,8)").alias("price"), F.col("l_quantity").cast("decimal(18,8)").alias("quantity"))


_FILLS_P = "l AS (SELECT l_suppkey AS symbol, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS us, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS DECIMAL(12,4)) AS price, CAST(l_quantity AS DECIMAL(12,2)) AS q FROM lineitem)"
_FILLS = "l AS (SELECT l_suppkey AS symbol, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS us, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS q FROM lineitem)"


_FIFO = f"""WITH {_FILLS_P}, r AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sign, coalesce(sum(CASE WHEN side = 'buy' THEN q ELSE -q END) OVER (PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
x AS (SELECT *, CASE WHEN before * sign < 0 THEN least(abs(before), q) ELSE 0 END AS leaves FROM r),
p AS (SELECT symbol, us, seq, price, 'exit' AS part, -sign AS direction, leaves AS u FROM x WHERE leaves > 0 UNION ALL SELECT symbol, us, seq, price, 'entry', sign, q - leaves FROM x WHERE q > leaves),
c AS (SELECT *, sum(u) OVER (PARTITION BY symbol, part ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS b FROM p),
m AS (
  SELECT e.symbol, e.us AS entry_us, e.seq AS entry_seq, o.us AS exit_us, o.seq AS exit_seq, e.direction, least(e.b, o.b) - greatest(e.b - e.u, o.b - o.u) AS quantity, e.price AS entry_price, o.price AS exit_price
  FROM c e JOIN c o ON e.symbol = o.symbol AND e.part = 'entry' AND o.part = 'exit' AND e.b - e.u < o.b AND o.b - o.u < e.b
)"""


@query("fifo_matching", _FIFO + " SELECT symbol, entry_us, entry_seq, exit_us, exit_seq, direction, CAST(quantity AS DOUBLE) AS quantity, CAST(entry_price AS DOUBLE) AS entry_price, CAST(exit_price AS DOUBLE) AS exit_price, round(CAST((exit_price - entry_price) * quantity * direction AS DOUBLE), 6) AS pnl FROM m")
def fifo_matching(spark, d):
    got = doubles(m.match_fifo(fills(spark, d), ["symbol"]), "quantity", "entry_price", "exit_price", "pnl")
    return got.withColumn("pnl", F.round("pnl", 6))


@query("reduced_fifo_matching", _FIFO + " SELECT symbol, exit_us, exit_seq, min(entry_us) AS entry_us, max(direction) AS direction, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(entry_price * quantity) AS DOUBLE) AS entry_cost, round(CAST(sum((exit_price - entry_price) * quantity * direction) AS DOUBLE), 6) AS pnl FROM m GROUP BY 1, 2, 3")
def reduced_fifo_matching(spark, d):
    """Trades for each fill that reduces a position."""
    got = m.reduced_trades(m.match_fifo(fills(spark, d), ["symbol"]), ["symbol"])
    return got.select("symbol", "exit_us", "exit_seq", "entry_us", "direction", F.col("quantity").cast("double").alias("quantity"), F.col("entry_cost").cast("double").alias("entry_cost"), F.round(F.col("pnl").cast("double"), 6).alias("pnl"))


@query("flat_to_flat_trades", _FIFO.split("),\nm AS")[0] + """), o AS (SELECT *, sum(CASE WHEN part = 'entry' THEN u ELSE -u END) OVER w = 0 AS flat, CASE part WHEN 'exit' THEN 0 ELSE 1 END AS step FROM p WINDOW w AS (PARTITION BY symbol ORDER BY us, seq, CASE part WHEN 'exit' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, coalesce(sum(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY us, seq, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM o)
SELECT symbol, min(us) AS entry_us, max(us) AS exit_us, max(direction) AS direction, CAST(sum(u) FILTER (part = 'entry') AS DOUBLE) AS quantity, CAST(sum(price * u) FILTER (part = 'entry') AS DOUBLE) AS entry_cost, CAST(sum(price * u) FILTER (part = 'exit') AS DOUBLE) AS exit_cost,
       round(CAST((sum(price * u) FILTER (part = 'exit') - sum(price * u) FILTER (part = 'entry')) * max(direction) AS DOUBLE), 6) AS pnl FROM s GROUP BY symbol, span HAVING bool_or(flat)""")
def flat_to_flat_trades(spark, d):
    return doubles(m.flat_trades(fills(spark, d), ["symbol"]), "quantity", "entry_cost", "exit_cost", "pnl").withColumn("pnl", F.round("pnl", 6))


def _matched(how):
    return lambda spark, d: doubles(m.match_fills(fills(spark, d), ["symbol"], how), "quantity", "entry_price", "exit_price", "pnl")


for _how in ("lifo", "flat", "reduced"):
    QUERIES[f"{_how}_matching"] = _matched(_how)


def closed(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as closed trades, by change of price from the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_orderkey", (F.col("o_totalprice").cast("decimal(18,2)") - F.lag(F.col("o_totalprice").cast("decimal(18,2)")).over(w)).alias("pnl"), F.col("o_orderdate").cast("date").alias("day"))
    return rows.where("pnl IS NOT NULL").withColumn("us_held", F.pmod("o_orderkey", F.lit(977)).cast("bigint"))


_CLOSED = "r AS (SELECT o_custkey % 50 AS k, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) - lag(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pnl, CAST(o_orderdate AS DATE) AS day, o_orderkey % 977 AS held FROM orders), x AS (SELECT * FROM r WHERE pnl IS NOT NULL)"


@query("trade_stats", f"""WITH {_CLOSED}, f AS (SELECT *, pnl > 0 AS flag FROM x WHERE pnl <> 0), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day, o_orderkey) - row_number() OVER (PARTITION BY k, flag ORDER BY day, o_orderkey) AS isl FROM f), h AS (SELECT k, flag, isl, count(*) AS n FROM g GROUP BY 1, 2, 3),
s AS (SELECT k, coalesce(max(n) FILTER (flag), 0) AS longest_wins, coalesce(max(n) FILTER (NOT flag), 0) AS longest_losses FROM h GROUP BY 1)
SELECT x.k, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl < 0) AS n_losses, CAST(sum(pnl) AS DOUBLE) AS total, CAST(coalesce(max(pnl) FILTER (pnl > 0), 0) AS DOUBLE) AS largest_profit, CAST(coalesce(min(pnl) FILTER (pnl < 0), 0) AS DOUBLE) AS largest_loss,
       list_sort(list(held))[count(*) // 2 + 1] AS median_held, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(CAST(sum(pnl) FILTER (pnl > 0) AS DOUBLE) / nullif(-CAST(sum(pnl) FILTER (pnl < 0) AS DOUBLE), 0), 6) AS profit_factor, any_value(longest_wins) AS longest_wins, any_value(longest_losses) AS longest_losses
FROM x JOIN s ON x.k = s.k GROUP BY 1""")
def trade_stats(spark, d):
    out = r.trade_statistics(closed(spark, d), ["k"], ["day", "o_orderkey"])
    return out.select("k", "n_trades", "n_wins", "n_losses", "total", "largest_profit", "largest_loss", "median_held", F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 6).alias("profit_factor"), "longest_wins", "longest_losses")


_REPORT = ("start_us end_us n_trades n_wins n_losses total profit loss largest_profit largest_loss mean_pnl mean_profit mean_loss mean_held mean_win_held mean_loss_held median_held median_win_held median_loss_held mean_mae mean_mfe largest_mae largest_mfe max_closed_drawdown max_intra_drawdown deviation downside_deviation "
    "max_end_drawdown max_drawdown_us fees longest_wins longest_losses profit_loss_ratio win_loss_ratio win_rate loss_rate profit_factor sharpe sortino profit_to_drawdown mean_end_drawdown").split()  # fmt: skip


def _places(c: str) -> int:
    """Times are large, money is small."""
    return 3 if c.endswith(("_us", "_held")) else 8


_REPORT_SQL = f"""WITH {_CLOSED}, e AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY day, o_orderkey) AS i, epoch_us(day) - held * 1000000 AS entry_us, epoch_us(day) AS exit_us, held * 1000000 AS held, pnl, pnl > 0 AS gain, CAST(least(pnl, 0) AS DOUBLE) - held AS mae, CAST(greatest(pnl, 0) AS DOUBLE) + held % 7 AS mfe, (held % 13)::DOUBLE AS end_drawdown, (held % 5)::DOUBLE AS fees FROM x),
a AS (SELECT *, CAST(sum(pnl) OVER w AS DOUBLE) AS after, sum(CASE WHEN gain THEN 0 ELSE 1 END) OVER w AS lost, first_value(entry_us) OVER w AS first_us FROM e WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, greatest(0, max(after) OVER w) AS top, greatest(0, coalesce(max(after) OVER p, 0)) AS past_top, greatest(0, max(after - CAST(pnl AS DOUBLE) + mfe) OVER w) AS open_top FROM a WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, gain AND after > past_top AS high FROM b),
u AS (SELECT *, CASE WHEN high AND lost > coalesce(last_value(CASE WHEN high THEN lost END IGNORE NULLS) OVER p, 0) THEN exit_us - coalesce(last_value(CASE WHEN high THEN exit_us END IGNORE NULLS) OVER p, first_us) END AS under, row_number() OVER (PARTITION BY k ORDER BY i) - row_number() OVER (PARTITION BY k, gain ORDER BY i) AS isl
      FROM h WINDOW p AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT k, coalesce(max(n) FILTER (gain), 0) AS longest_wins, coalesce(max(n) FILTER (NOT gain), 0) AS longest_losses FROM (SELECT k, gain, isl, count(*) AS n FROM u GROUP BY 1, 2, 3) GROUP BY 1),
g AS (
  SELECT k, min(entry_us) AS start_us, max(exit_us) AS end_us, count(*) AS n_trades, count(*) FILTER (gain) AS n_wins, count(*) FILTER (NOT gain) AS n_losses, CAST(sum(pnl) AS DOUBLE) AS total, coalesce(CAST(sum(pnl) FILTER (gain) AS DOUBLE), 0) AS profit, coalesce(CAST(sum(pnl) FILTER (NOT gain) AS DOUBLE), 0) AS loss,
         coalesce(CAST(max(pnl) FILTER (gain) AS DOUBLE), 0) AS largest_profit, least(0, CAST(min(pnl) AS DOUBLE)) AS largest_loss, avg(CAST(pnl AS DOUBLE)) AS mean_pnl, coalesce(avg(CAST(pnl AS DOUBLE)) FILTER (gain), 0) AS mean_profit, coalesce(avg(CAST(pnl AS DOUBLE)) FILTER (NOT gain), 0) AS mean_loss,
         avg(held) AS mean_held, coalesce(avg(held) FILTER (gain), 0) AS mean_win_held, coalesce(avg(held) FILTER (NOT gain), 0) AS mean_loss_held, list_sort(list(held))[count(*) // 2 + 1] AS median_held, list_sort(list(held) FILTER (gain))[count(*) FILTER (gain) // 2 + 1] AS median_win_held, list_sort(list(held) FILTER (NOT gain))[count(*) FILTER (NOT gain) // 2 + 1] AS median_loss_held,
         avg(mae) AS mean_mae, avg(mfe) AS mean_mfe, least(0, min(mae)) AS largest_mae, greatest(0, max(mfe)) AS largest_mfe, least(0, min(after - top) FILTER (NOT gain)) AS max_closed_drawdown, least(0, min(after - CAST(pnl AS DOUBLE) + mae - open_top)) AS max_intra_drawdown, coalesce(stddev_samp(CAST(pnl AS DOUBLE)), 0) AS deviation, coalesce(stddev_samp(CAST(pnl AS DOUBLE)) FILTER (NOT gain), 0) AS downside_deviation,
         greatest(0, max(end_drawdown)) AS max_end_drawdown, coalesce(max(under), 0) AS max_drawdown_us, sum(fees) AS fees FROM u GROUP BY 1
), m AS (
  SELECT *, coalesce(mean_profit / nullif(abs(mean_loss), 0), 0) AS profit_loss_ratio, CASE WHEN n_losses > 0 THEN n_wins / n_losses ELSE 10 END AS win_loss_ratio, n_wins / n_trades AS win_rate, 1 - n_wins / n_trades AS loss_rate, CASE WHEN profit = 0 THEN 0 WHEN loss < 0 THEN profit / abs(loss) ELSE 10 END AS profit_factor,
         coalesce(mean_pnl / nullif(deviation, 0), 0) AS sharpe, coalesce(mean_pnl / nullif(downside_deviation, 0), 0) AS sortino, CASE WHEN total = 0 THEN 0 WHEN max_closed_drawdown < 0 THEN total / abs(max_closed_drawdown) ELSE 10 END AS profit_to_drawdown, mean_pnl - mean_mfe AS mean_end_drawdown FROM g JOIN s USING (k)
) SELECT k, """ + ", ".join(f"round(CAST({c} AS DOUBLE), {_places(c)}) AS {c}" for c in _REPORT) + " FROM m"


@query("trade_report", _REPORT_SQL)
def trade_report(spark, d):
    """Every measure of closed trades; excursions, drawdowns and fees are made up from the days held."""
    us, held = F.unix_date("day").cast("bigint") * DAY, F.col("us_held")
    rows = closed(spark, d).select("k", "day", "o_orderkey", "pnl", (us - held * 1_000_000).alias("entry_us"), us.alias("exit_us"), (F.least(F.col("pnl").cast("double"), F.lit(0.0)) - held).alias("mae"), (F.greatest(F.col("pnl").cast("double"), F.lit(0.0)) + held % 7).alias("mfe"), (held % 13).cast("double").alias("end_drawdown"), (held % 5).cast("double").alias("fees"))
    out = r.trade_report(rows, ["k"], ["day", "o_orderkey"])
    return out.select("k", *[F.round(F.col(c).cast("double"), _places(c)).alias(c) for c in _REPORT])


@query("expectancy", f"""WITH {_CLOSED}, c AS (SELECT *, CAST(pnl AS DOUBLE) / (100000000 + coalesce(CAST(sum(pnl) OVER (PARTITION BY k ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)) AS rate FROM x),
a AS (SELECT k, coalesce(avg(rate) FILTER (pnl > 0), 0) AS mw, coalesce(avg(rate) FILTER (pnl < 0), 0) AS ml, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS wr, avg(CASE WHEN pnl < 0 THEN 1.0::DOUBLE ELSE 0 END) AS lr FROM c GROUP BY 1)
SELECT k, round(mw, 8) AS mean_win, round(ml, 8) AS mean_loss, round(wr * coalesce(mw / nullif(abs(ml), 0), 0) - lr, 6) AS expectancy FROM a""")
def expectancy(spark, d):
    out = r.expectancy(closed(spark, d), ["k"], ["day", "o_orderkey"], 1e8)
    return out.select("k", F.round("mean_win", 8).alias("mean_win"), F.round("mean_loss", 8).alias("mean_loss"), F.round("expectancy", 6).alias("expectancy"))
