"""Queries of universes, adjustment, checks, books, liquidity, orders, experiments, streams and sources."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import adjust as ad
from quern.operators import bars as b
from quern.operators import book as bk
from quern.operators import features as ft
from quern.operators import liquidity as lq
from quern.operators import orders as od
from quern.operators import portfolio as pf
from quern.operators import universe as un
from quern.operators import validate as va
from quern.operators.events import user_book
from quern.plans import runner
from quern.plans.q_bars import DAY, doubles
from quern.plans.q_grid import _BOTH, END, HOUR, JOB, OBS, QUOTES, START, STEP, TRADES, bucket_sql, observed, observed_both, quotes, trades
from quern.shards import plan_shards
from quern.sources import feeds, sinks
from quern.streaming import live
from quern.tables import table
from quern.workdir import fresh_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ---- universes

TODAY = "2024-01-01"
_CONTRACTS = "c AS (SELECT p_partkey AS id, p_brand AS underlying, DATE '2024-01-01' + CAST(p_size AS INT) AS expiry, CAST(p_retailprice AS DOUBLE) AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS \"right\", CAST(1000 + p_size AS DOUBLE) AS spot FROM part)"


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Adapter F: parts as option contracts of their brand."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("underlying"), F.date_add(F.to_date(F.lit(TODAY)), F.col("p_size").cast("int")).alias("expiry"), F.col("p_retailprice").cast("double").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("right"), (1000 + F.col("p_size")).cast("double").alias("spot"))


_RANKED = f"WITH {_CONTRACTS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY expiry) AS r FROM c) SELECT id, underlying, expiry FROM k WHERE r "


@query("front_month", _RANKED + "= 1")
def front_month(spark, d):
    return un.front_month(contracts(spark, d), ["underlying"]).select("id", "underlying", "expiry")


@query("back_month", _RANKED + "= 2")
def back_month(spark, d):
    return un.back_months(contracts(spark, d), ["underlying"], only_next=True).select("id", "underlying", "expiry")


@query("back_months", _RANKED + "> 1")
def back_months(spark, d):
    return un.back_months(contracts(spark, d), ["underlying"]).select("id", "underlying", "expiry")


@query("expiry_range", f"WITH {_CONTRACTS} SELECT id, expiry FROM c WHERE expiry BETWEEN DATE '2024-01-08' AND DATE '2024-01-31' AND \"right\" = 'call'")
def expiry_range(spark, d):
    return un.expiring_within(contracts(spark, d), TODAY, 7, 30).where("right = 'call'").select("id", "expiry")


@query("expiration_cycle", f"WITH {_CONTRACTS} SELECT id, expiry FROM c WHERE month(expiry) IN (1, 3, 6, 9, 12)")
def expiration_cycle(spark, d):
    return un.expiration_cycle(contracts(spark, d), (1, 3, 6, 9, 12)).select("id", "expiry")


@query("strike_window", f"""WITH {_CONTRACTS}, u AS (SELECT *, 905.0::DOUBLE AS at_spot FROM c), k AS (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY strike) - 1 AS r FROM u),
m AS (SELECT underlying, min(r) AS atm, bool_or(strike = at_spot) AS exact FROM k WHERE strike >= at_spot GROUP BY 1)
SELECT id, k.underlying, strike FROM k JOIN m ON k.underlying = m.underlying WHERE r BETWEEN atm - 2 AND atm + CASE WHEN exact THEN 2 ELSE 1 END""")
def strike_window(spark, d):
    return un.strike_window(contracts(spark, d).withColumn("at_spot", F.lit(905.0)), ["underlying"], "at_spot", -2, 2).select("id", "underlying", "strike")


@query("nearest_strike", f"WITH {_CONTRACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY underlying, \"right\" ORDER BY abs(strike - 908), id) AS r FROM c) SELECT underlying, \"right\", id, strike FROM k WHERE r = 1")
def nearest_strike(spark, d):
    return un.nearest_strike(contracts(spark, d), ["underlying", "right"], F.lit(908.0)).select("underlying", "right", "id", "strike")


@query("vertical_spread", f"""WITH {_CONTRACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - 903), id) AS r FROM c), lo AS (SELECT underlying, strike AS low_strike FROM k WHERE r = 1),
h AS (SELECT c.underlying, low_strike, strike, row_number() OVER (PARTITION BY c.underlying ORDER BY abs(strike - 910), id) AS r FROM c JOIN lo ON c.underlying = lo.underlying WHERE strike > low_strike)
SELECT underlying, low_strike, strike AS high_strike FROM h WHERE r = 1""")
def vertical_spread(spark, d):
    return un.vertical_spread(contracts(spark, d).withColumn("at", F.lit(905.0)), ["underlying"], "at", -2, 5)


@query("calendar_spread", f"WITH {_CONTRACTS}, n AS (SELECT underlying, min(expiry) AS near_expiry FROM c WHERE expiry >= DATE '2024-01-06' GROUP BY 1) SELECT c.underlying, any_value(near_expiry) AS near_expiry, min(expiry) AS far_expiry FROM c JOIN n ON c.underlying = n.underlying WHERE expiry > near_expiry AND expiry >= DATE '2024-01-21' GROUP BY 1")
def calendar_spread(spark, d):
    return un.calendar_spread(contracts(spark, d), ["underlying"], 5, 20, TODAY)


@query("contract_ranges", f"WITH {_CONTRACTS} SELECT id, strike, spot FROM c WHERE strike BETWEEN 905 AND 1500 AND spot <= 1030")
def contract_ranges(spark, d):
    return un.within_ranges(contracts(spark, d), {"strike": (905.0, 1500.0), "spot": (None, 1030.0)}).select("id", "strike", "spot")


@query("standard_contracts", f"WITH {_CONTRACTS} SELECT id, expiry, dayofweek(expiry) = 5 AND day(expiry) BETWEEN 15 AND 21 AS standard FROM c")
def standard_contracts(spark, d):
    return contracts(spark, d).select("id", "expiry", un.is_standard_expiry("expiry").alias("standard"))


@query("strangle_legs", f"""WITH {_CONTRACTS}, e AS (SELECT underlying, min(expiry) AS expiry FROM c WHERE expiry >= DATE '2024-01-11' GROUP BY 1), x AS (SELECT c.* FROM c JOIN e ON c.underlying = e.underlying AND c.expiry = e.expiry),
k AS (SELECT *, 0 AS leg, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - 903), id) AS r FROM x WHERE "right" = 'put' UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - 910), id) FROM x WHERE "right" = 'call'),
w AS (SELECT *, count(*) OVER (PARTITION BY underlying) AS n FROM k WHERE r = 1) SELECT underlying, leg, "right", expiry, strike, id FROM w WHERE n = 2""")
def strangle_legs(spark, d):
    return un.strategy_legs(contracts(spark, d).withColumn("at", F.lit(905.0)), ["underlying"], "at", TODAY, 10, [("put", -2), ("call", 5)])


_SNAP = f"WITH {TRADES}, g AS (SELECT us // {7 * DAY} AS week, symbol, CAST(sum(price * quantity) AS DOUBLE) AS dollars FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY dollars DESC, symbol) AS rank FROM g)"


def _top(spark, d):
    g = trades(spark, d).groupBy(F.floor(F.col("us") / (7 * DAY)).alias("week"), "symbol").agg(F.sum((F.col("price") * F.col("quantity")).cast("decimal(38,8)")).cast("double").alias("dollars"))
    return un.top_by(g, ["week"], "dollars", 5, "symbol")


@query("topk_dollar_volume", _SNAP + " SELECT week, symbol, round(dollars, 4) AS dollars, rank FROM k WHERE rank <= 5")
def topk_dollar_volume(spark, d):
    return _top(spark, d).withColumn("dollars", F.round("dollars", 4))


@query("universe_diff", _SNAP + ", u AS (SELECT week, symbol FROM k WHERE rank <= 5), w AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT week FROM u)) SELECT u.week, u.symbol, 'added' AS change FROM u JOIN w ON u.week = w.week LEFT JOIN u p ON p.week = w.before AND p.symbol = u.symbol WHERE p.symbol IS NULL UNION ALL SELECT w.week, p.symbol, 'removed' FROM u p JOIN w ON p.week = w.before LEFT JOIN u ON u.week = w.week AND u.symbol = p.symbol WHERE u.symbol IS NULL")
def universe_diff(spark, d):
    return un.members_diff(_top(spark, d), "week", "symbol")


@query("prefilter_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def prefilter_semi(spark, d):
    members = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return un.members_only(table(spark, d, "orders").select("o_orderkey", "o_custkey"), members, ["o_custkey"])


@query("constituent_weights", "WITH m AS (SELECT c_nationkey AS etf, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) SELECT etf, c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY etf), 8) AS weight FROM m")
def constituent_weights(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("etf"), "c_custkey", F.col("c_acctbal").cast("double").alias("x"))
    return un.constituent_weights(rows, ["etf"], "x").select("etf", "c_custkey", F.round("weight", 8).alias("weight"))


@query("metric_rollup", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def metric_rollup(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    return lq.subtotals(rows, ["flag", "status"], [F.count("*").alias("n"), F.sum("q").cast("double").alias("quantity")])


# ---- adjustment and versions


@query("price_modes", "SELECT o_orderkey, round(p, 6) AS raw, round(p * 0.5 * f, 6) AS adjusted, round(p * f, 6) AS split_adjusted, round(p * 0.5 * f / 0.5, 6) AS scaled_raw, round(p * f + 3, 6) AS total_return, round(p * 0.5, 6) AS backwards_ratio, round(p - 7, 6) AS panama FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p, 1.0 / (1 + o_custkey % 4) AS f FROM orders)")
def price_modes(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), (1.0 / (1 + F.col("o_custkey") % 4)).alias("f"))
    mode = lambda m: F.round(ad.normalize(F.col("p"), m, F.lit(0.5), F.col("f"), F.lit(0.5), F.lit(3.0), F.lit(-7.0)), 6).alias(m)
    return rows.select("o_orderkey", *[mode(m) for m in ad.MODES])


@query("factor_products", "WITH a AS (SELECT s_nationkey AS k, s_suppkey AS d, 0.5 + (s_suppkey % 10) / 10.0 AS ratio FROM supplier) SELECT k, d, round(exp(sum(ln(ratio)) OVER (PARTITION BY k ORDER BY d DESC ROWS UNBOUNDED PRECEDING)), 8) AS factor FROM a")
def factor_products(spark, d):
    acts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("date"), (0.5 + (F.col("s_suppkey") % 10) / 10.0).alias("ratio"))
    return ad.factors_from_actions(acts, ["k"]).select("k", F.col("date").alias("d"), F.round("factor", 8).alias("factor"))


@query("dedupe_merge_latest", "SELECT symbol, venue, timestamp_ms, bar_id, CAST(close AS DOUBLE) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue, timestamp_ms ORDER BY arrival_ms DESC, bar_id DESC) AS n FROM bars) WHERE n = 1")
def dedupe_merge_latest(spark, d):
    rows = table(spark, d, "bars")
    even, odd = rows.where("bar_id % 2 = 0"), rows.where("bar_id % 2 = 1")
    out = ad.merge_latest(even, odd, ["symbol", "venue", "timestamp_ms"], ["arrival_ms", "bar_id"])
    return out.select("symbol", "venue", "timestamp_ms", "bar_id", F.col("close").cast("double").alias("close"))


# ---- checks


def _checked(spark, d):
    names = ("mid_price", "spread", "bid_depth", "ask_depth", "imbalance", "net_flow", "aggressive_buy_volume", "aggressive_sell_volume", "trade_flow", "trade_intensity")
    raw = ("bid_price", "ask_price", "volume", "trade_count", "vwap", "high_price", "low_price")
    return ft.feature_rows(observed_both(spark, d), {n: {} for n in names}, raw, keep=("last_us",))


@query("validate_flow_identity")
def validate_flow_identity(spark, d):
    return va.check_flow(_checked(spark, d))


@query("validate_market_state")
def validate_market_state(spark, d):
    return va.check_market_state(_checked(spark, d)).unionByName(va.check_observation(_checked(spark, d))).unionByName(va.check_numeric(_checked(spark, d), ["mid_price", "spread", "vwap"]))


@query("validate_planted", f"WITH {OBS} SELECT 'flow' AS check_id, symbol, 'net flow is not buys less sells' AS message, count(*) AS n, min(bucket) AS first, max(bucket) AS last FROM obs WHERE n > 2 GROUP BY 2 UNION ALL SELECT 'observation', symbol, 'high below low', count(*), min(bucket), max(bucket) FROM obs WHERE n > 0 AND h > l GROUP BY 2 UNION ALL SELECT 'market_state', symbol, 'imbalance out of range', count(*), min(bucket), max(bucket) FROM obs WHERE n = 1 GROUP BY 2")
def validate_planted(spark, d):
    """Findings in observations that were spoilt: net flow where a bucket has many trades, high and low exchanged, imbalance where it has one."""
    rows = ft.feature_rows(observed(spark, d), {n: {} for n in ("mid_price", "bid_depth", "ask_depth", "imbalance", "net_flow", "aggressive_buy_volume", "aggressive_sell_volume")}, ("bid_price", "ask_price", "volume", "trade_count", "vwap", "high_price", "low_price"))
    some = F.col("trade_count")
    rows = rows.withColumn("net_flow", F.when(some > 2, F.col("net_flow") + 1).otherwise(F.col("net_flow"))).withColumn("imbalance", F.when(some == 1, F.lit(2.0)).otherwise(F.col("imbalance")))
    turned = rows.withColumns({"high_price": F.col("low_price"), "low_price": F.col("high_price"), "vwap": F.lit(None).cast("double")})
    got = va.check_flow(rows).unionByName(va.check_observation(turned)).unionByName(va.check_market_state(rows))
    return got.select("check_id", "symbol", "message", "n", "first", "last")


@query("validate_quotes", "SELECT symbol, 'crossed' AS message, count(*) AS n, min(timestamp_ms) AS first, max(timestamp_ms) AS last FROM quotes WHERE bid_price > ask_price GROUP BY 1 UNION ALL SELECT symbol, 'no price', count(*), min(timestamp_ms), max(timestamp_ms) FROM quotes WHERE bid_price IS NULL OR ask_price IS NULL GROUP BY 1")
def validate_quotes(spark, d):
    rows = table(spark, d, "quotes").select("symbol", "timestamp_ms", "bid_price", "ask_price")
    rules = {"crossed": F.col("bid_price") <= F.col("ask_price"), "no price": F.col("bid_price").isNotNull() & F.col("ask_price").isNotNull()}
    return va.findings(rows, "quotes", rules, at="timestamp_ms").select("symbol", "message", "n", "first", "last")


@query("validate_degenerate", f"WITH {OBS} SELECT symbol, 'sells' AS \"column\", CAST(min(sell) AS DOUBLE) AS value, count(*) AS rows FROM obs GROUP BY 1 HAVING min(sell) = max(sell) UNION ALL SELECT symbol, 'buys', CAST(min(buy) AS DOUBLE), count(*) FROM obs GROUP BY 1 HAVING min(buy) = max(buy) UNION ALL SELECT symbol, 'none', 0, count(*) FROM obs GROUP BY 1")
def validate_degenerate(spark, d):
    rows = observed(spark, d).select("symbol", F.col("aggressive_sell_volume").alias("sells"), F.col("aggressive_buy_volume").alias("buys"), F.lit(0).alias("none"))
    return va.check_degenerate(rows, ["sells", "buys", "none"]).select("symbol", "column", "value", "rows")


@query("validate_duplicate_cols", f"WITH {OBS} SELECT symbol, 'flow' AS \"left\", 'net' AS \"right\" FROM obs GROUP BY 1 UNION ALL SELECT symbol, 'buys', 'sells' FROM obs GROUP BY 1 HAVING bool_and(buy = sell) UNION ALL SELECT symbol, 'flow', 'buys' FROM obs GROUP BY 1 HAVING bool_and(sell = 0) UNION ALL SELECT symbol, 'net', 'buys' FROM obs GROUP BY 1 HAVING bool_and(sell = 0) UNION ALL SELECT symbol, 'flow', 'sells' FROM obs GROUP BY 1 HAVING bool_and(buy - sell = sell) UNION ALL SELECT symbol, 'net', 'sells' FROM obs GROUP BY 1 HAVING bool_and(buy - sell = sell)")
def validate_duplicate_cols(spark, d):
    buy, sell = F.col("aggressive_buy_volume"), F.col("aggressive_sell_volume")
    rows = observed(spark, d).select("symbol", (buy - sell).alias("flow"), (buy - sell).alias("net"), buy.alias("buys"), sell.alias("sells"))
    return va.check_duplicate(rows, ["flow", "net", "buys", "sells"]).select("symbol", "left", "right")


@query("validate_grid_steps", f"WITH {OBS}, g AS (SELECT *, bucket - lag(bucket) OVER (PARTITION BY symbol ORDER BY bucket) AS gap FROM obs WHERE n > 0) SELECT symbol, count(*) AS n, min(bucket) AS first, max(bucket) AS last FROM g WHERE gap <> {STEP} GROUP BY 1")
def validate_grid_steps(spark, d):
    rows = observed(spark, d).where("event_count > 0")
    return va.check_grid(rows, STEP).where("message = 'steps are not uniform'").select("symbol", "n", "first", "last")


@query("validate_freshness", f"WITH {OBS} SELECT symbol, count(*) AS rows, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS filled_share, round(avg(CASE WHEN quality = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_share, round(max(coalesce((bucket - last_us) / 1000.0, -1)), 3) AS max_age_ms FROM obs GROUP BY 1")
def validate_freshness(spark, d):
    return va.check_freshness(observed(spark, d)).select("symbol", "rows", "filled_share", "missing_share", F.round("max_age_ms", 3).alias("max_age_ms"))


@query("validate_coverage", f"WITH {OBS}, g AS (SELECT symbol, min(bucket) AS first, max(bucket) AS last, count(*) AS fresh FROM obs WHERE quality = 2 GROUP BY 1) SELECT *, first > {START + STEP} AS starts_late, last < {END - STEP} AS ends_early FROM g")
def validate_coverage(spark, d):
    return va.check_coverage(observed(spark, d), START, END, STEP)


# ---- books and liquidity

_BOOK = "k AS (SELECT 'U' || user_id AS symbol, epoch_us(ts) AS us, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CAST(floor(value / 10) * 10 AS DOUBLE) AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS q FROM events)"
_DELTA = f"{_BOOK}, z AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY symbol, side, price ORDER BY us, seq), 0) AS delta FROM k), r AS (SELECT *, sum(CASE WHEN side = 'bid' THEN delta ELSE 0 END) OVER w AS bid_depth, sum(CASE WHEN side = 'ask' THEN delta ELSE 0 END) OVER w AS ask_depth FROM z WINDOW w AS (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING))"


def _depth(spark, d):
    rows = user_book(table(spark, d, "events"))
    return bk.running_depth(rows, plan=plan_shards(rows, ["symbol"], "us"))


@query("depth_running_delta", f"WITH {_DELTA} SELECT symbol, us, seq, CAST(bid_depth AS DOUBLE) AS bid_depth, CAST(ask_depth AS DOUBLE) AS ask_depth FROM r")
def depth_running_delta(spark, d):
    return doubles(_depth(spark, d), "bid_depth", "ask_depth").select("symbol", "us", "seq", "bid_depth", "ask_depth")


_MINUTE = 60_000_000
_BOOK_FOLD = f"""WITH u AS (
  SELECT DISTINCT ON (change_id) symbol || '@' || venue AS symbol, timestamp_ms * 1000 AS us, coalesce(seq, -1) AS seq, change_id, lower(side) AS side, price, CASE WHEN lower(coalesce(action, 'add')) = 'remove' OR quantity IS NULL THEN 0 ELSE quantity END AS q
  FROM book_updates WHERE timestamp_ms IS NOT NULL AND price IS NOT NULL
), b AS (SELECT *, (us + {_MINUTE - 1}) // {_MINUTE} * {_MINUTE} AS bucket FROM u),
l AS (SELECT symbol, side, price, bucket, arg_max(q, (us, seq, change_id)) AS q FROM b WHERE side IN ('bid', 'ask') GROUP BY 1, 2, 3, 4),
v AS (SELECT *, lead(bucket) OVER (PARTITION BY symbol, side, price ORDER BY bucket) AS until FROM l),
k AS (SELECT DISTINCT symbol, bucket FROM b),
x AS (SELECT k.symbol, k.bucket, v.side, v.price, v.q FROM k LEFT JOIN v ON v.symbol = k.symbol AND v.q > 0 AND v.bucket <= k.bucket AND (v.until IS NULL OR v.until > k.bucket))
SELECT symbol, bucket, CAST(max(price) FILTER (side = 'bid') AS DOUBLE) AS best_bid, CAST(min(price) FILTER (side = 'ask') AS DOUBLE) AS best_ask, CAST(coalesce(sum(q) FILTER (side = 'bid'), 0) AS DOUBLE) AS bid_depth,
       CAST(coalesce(sum(q) FILTER (side = 'ask'), 0) AS DOUBLE) AS ask_depth, CAST(count(*) FILTER (side = 'bid') AS INT) AS n_bids, CAST(count(*) FILTER (side = 'ask') AS INT) AS n_asks FROM x GROUP BY 1, 2"""


@query("book_fold", _BOOK_FOLD)
def book_fold(spark, d):
    """Books of the staged feed at the end of each minute, from repeated and late changes put in order of time, seq, change."""
    rows = table(spark, d, "book_updates").dropDuplicates(["change_id"]).withColumn("symbol", F.concat_ws("@", "symbol", "venue"))
    ev = feeds.feed_events(rows, "book_updates", F.col("symbol"), F.col("venue"), seq=F.coalesce("seq", F.lit(-1)), keep=["change_id"])
    states = bk.book_states(ev, _MINUTE, depth=0, ties=["change_id"])
    return doubles(states, "best_bid", "best_ask", "bid_depth", "ask_depth").select("symbol", "bucket", "best_bid", "best_ask", "bid_depth", "ask_depth", "n_bids", "n_asks")


_STRUCTURE = f"""WITH {OBS}, {_BOOK}, w AS (SELECT symbol, side, price, us, q, lead(us) OVER (PARTITION BY symbol, side, price ORDER BY us, seq) AS next_us FROM k),
v AS (SELECT o.symbol, o.bucket, w.side, w.price, w.q::DOUBLE AS q, coalesce(o.last, 0)::DOUBLE AS mid FROM obs o JOIN w ON w.symbol = o.symbol AND w.us <= o.bucket AND (w.next_us IS NULL OR w.next_us > o.bucket) WHERE w.q > 0),
m AS (SELECT *, avg(q) OVER (PARTITION BY symbol, bucket) AS mean, avg(q) FILTER (side = 'ask') OVER (PARTITION BY symbol, bucket) AS ask_mean FROM v),
g AS (
  SELECT symbol, bucket, sum(q) FILTER (side = 'bid') AS bid, sum(q) FILTER (side = 'ask') AS ask, count(*) AS n, count(*) FILTER (side = 'ask') AS asks,
         coalesce(sum(q) FILTER (side = 'bid' AND price >= mid * (1 - 5000 / 1e4)), 0) AS in_bid, coalesce(sum(q) FILTER (side = 'ask' AND price <= mid * (1 + 5000 / 1e4)), 0) AS in_ask,
         min(abs(price - mid) / mid * 1e4) FILTER (q > 1.5 * mean) AS wall, (min(price) FILTER (side = 'ask' AND q > 1.2 * ask_mean AND price > mid) - any_value(mid)) / any_value(mid) * 1e4 AS resist
  FROM m GROUP BY 1, 2
), f AS (
  SELECT o.symbol, o.bucket, coalesce(o.last, 0)::DOUBLE AS mid, coalesce(bid, 0) AS bid, coalesce(ask, 0) AS ask, coalesce(g.n, 0) AS n, coalesce(asks, 0) AS asks, coalesce(in_bid, 0) AS in_bid, coalesce(in_ask, 0) AS in_ask, wall, resist FROM obs o LEFT JOIN g ON g.symbol = o.symbol AND g.bucket = o.bucket
), h AS (SELECT *, in_bid + in_ask AS near, row_number() OVER s AS place, count(*) OVER t AS back FROM f WINDOW s AS (PARTITION BY symbol ORDER BY bucket), t AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT symbol, bucket, bid AS bid_depth, ask AS ask_depth, round(CASE WHEN in_bid + in_ask <> 0 THEN (in_bid - in_ask) / (in_bid + in_ask) ELSE 0 END, 8) AS structural_imbalance,
       round(CASE WHEN n >= 3 AND mid > 0 THEN coalesce(wall, 0) ELSE 0 END, 6) AS wall, round(CASE WHEN asks >= 2 AND mid > 0 THEN coalesce(resist, 0) ELSE 0 END, 6) AS resistance,
       CASE WHEN place > 2 THEN near - coalesce(lag(near, 6) OVER s, first_value(near) OVER s) ELSE 0 END AS liquidity_depletion,
       round(CASE WHEN back >= 2 THEN (lag(near) OVER s - first_value(near) OVER t) / back ELSE 0 END, 8) AS replenishment_rate
FROM h WINDOW s AS (PARTITION BY symbol ORDER BY bucket), t AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


@query("book_structure", _STRUCTURE)
def book_structure(spark, d):
    """Features of all levels of the book at the grid points of trades."""
    rows = bk.with_book(observed(spark, d), user_book(table(spark, d, "events")), STEP, START)
    band = {"bps": "5000"}
    got = ft.feature_rows(rows, {"bid_depth": {}, "ask_depth": {}, "structural_imbalance": band, "liquidity_wall": {"mult": "1.5"}, "resistance": {"factor": "1.2"}, "liquidity_depletion": band, "replenishment_rate": band})
    places = {"structural_imbalance_5000bps": ("structural_imbalance", 8), "liquidity_wall_1.5x": ("wall", 6), "resistance_1.2x": ("resistance", 6), "replenishment_rate": ("replenishment_rate", 8)}
    return got.select("symbol", "bucket", "bid_depth", "ask_depth", "liquidity_depletion", *[F.round(F.col(f"`{c}`"), n).alias(short) for c, (short, n) in places.items()])


@query("seq_gap_count", "WITH s AS (SELECT symbol, venue, seq, seq - lag(seq) OVER (PARTITION BY symbol, venue ORDER BY seq) AS step FROM (SELECT DISTINCT symbol, venue, seq FROM book_updates WHERE seq IS NOT NULL)) SELECT symbol, venue, count(*) FILTER (step > 1) AS n_gaps, CAST(coalesce(sum(step - 1) FILTER (step > 1), 0) AS BIGINT) AS n_missing FROM s GROUP BY 1, 2")
def seq_gap_count(spark, d):
    return bk.sequence_gaps(table(spark, d, "book_updates"), ["symbol", "venue"])


@query("level_actions", f"WITH {_BOOK}, z AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY symbol, side, price ORDER BY us, seq), 0) AS was FROM k), a AS (SELECT symbol, side, CASE WHEN q = 0 THEN CASE WHEN was > 0 THEN 'remove' END WHEN was = 0 THEN 'add' WHEN was <> q THEN 'modify' END AS action FROM z) SELECT symbol, side, action, count(*) AS n FROM a WHERE action IS NOT NULL GROUP BY 1, 2, 3")
def level_actions(spark, d):
    return bk.level_changes(user_book(table(spark, d, "events")).drop("action")).groupBy("symbol", "side", "action").agg(F.count("*").alias("n"))


_STATES = f"{_DELTA}, s AS (SELECT symbol, us, CAST(bid_depth AS DOUBLE) AS b, CAST(ask_depth AS DOUBLE) AS a, 100 + (seq % 7) AS bb, 101 + (seq % 5) AS ba FROM r), p AS (SELECT *, lag(us) OVER w AS us0, lag(b) OVER w AS b0, lag(a) OVER w AS a0, lag(bb) OVER w AS bb0, lag(ba) OVER w AS ba0 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY us)), v AS (SELECT * FROM p WHERE us - us0 BETWEEN 0 AND {DAY})"


def _side_sql(s: str, d: str, p: str) -> str:
    return f"SELECT symbol, us, '{s}' AS side, CASE WHEN {d}0 > 0 AND {d}0 > {d} AND {d}0 - {d} >= {d}0 * 0.3 THEN 'depletion' WHEN {d}0 > 0 AND {d} > {d}0 AND {d} - {d}0 >= {d}0 * 0.3 THEN 'replenishment' WHEN abs({p} - {p}0) / {p}0 * 10000 >= 250 THEN 'migration' END AS type, {d}0 AS depth_before, {d} AS depth_after FROM v"


_EVENTS = f"WITH {_STATES}, e AS (SELECT * FROM ({_side_sql('bid', 'b', 'bb')} UNION ALL {_side_sql('ask', 'a', 'ba')}) WHERE type IS NOT NULL)"


def _transitions(spark, d):
    rows = _depth(spark, d).select("symbol", "us", "bid_depth", "ask_depth", (100 + F.col("seq") % 7).cast("double").alias("best_bid"), (101 + F.col("seq") % 5).cast("double").alias("best_ask"))
    return lq.transitions(rows, lq.Thresholds(move_bps=250, gap_us=DAY))


@query("liquidity_transitions", _EVENTS + " SELECT symbol, us, side, type, depth_before, depth_after FROM e")
def liquidity_transitions(spark, d):
    return _transitions(spark, d).select("symbol", "us", "side", "type", "depth_before", "depth_after")


@query("replenish_latency", _EVENTS + f", n AS (SELECT *, lead(type) OVER w AS nt, lead(us) OVER w AS nu FROM e WHERE type IN ('depletion', 'replenishment') WINDOW w AS (PARTITION BY symbol, side ORDER BY us)) SELECT symbol, side, us, CASE WHEN nt = 'replenishment' AND nu - us <= {DAY} THEN (nu - us) / 1000.0 END AS ms_until_replenishment FROM n WHERE type = 'depletion'")
def replenish_latency(spark, d):
    return lq.replenished(_transitions(spark, d), DAY)


@query("liquidity_metrics", _EVENTS + " SELECT coalesce(type, '*') AS type, coalesce(side, '*') AS side, count(*) AS n, round(avg(depth_after - depth_before), 6) AS mean_delta FROM e GROUP BY ROLLUP (type, side)")
def liquidity_metrics(spark, d):
    return lq.event_metrics(_transitions(spark, d)).select(F.coalesce("type", F.lit("*")).alias("type"), F.coalesce("side", F.lit("*")).alias("side"), "n", "mean_delta")


_OUTCOMES = _EVENTS + f""", m AS (SELECT symbol, us, (bb + ba) / 2.0::DOUBLE AS mid FROM s), x AS (SELECT *, max(mid) OVER w AS top, min(mid) OVER w AS low FROM m WINDOW w AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {2 * DAY} FOLLOWING)),
y AS (SELECT x.*, f.mid AS future FROM x ASOF LEFT JOIN m f ON f.symbol = x.symbol AND x.us + {2 * DAY} <= f.us), o AS (SELECT e.*, future / mid - 1 AS ret, top / mid - 1 AS mfe, low / mid - 1 AS mae FROM e JOIN y ON y.symbol = e.symbol AND y.us = e.us)"""


@query("transition_outcomes", _OUTCOMES + f" SELECT type, side, {2 * DAY}::BIGINT AS horizon, count(*) AS n, count(ret) AS n_resolved, round(avg(ret), 8) AS mean_ret, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END), 8) AS up_rate, round(avg(mfe), 8) AS mean_mfe, round(avg(mae), 8) AS mean_mae FROM o GROUP BY 1, 2")
def transition_outcomes(spark, d):
    """What the price did in the two days after each transition."""
    prices = _depth(spark, d).select("symbol", "us", ((201 + F.col("seq") % 7 + F.col("seq") % 5) / 2.0).alias("mid"))
    got = lq.outcome_metrics(lq.outcomes(_transitions(spark, d), prices, [2 * DAY]))
    return got.select("type", "side", "horizon", "n", "n_resolved", *[F.round(c, 8).alias(c) for c in ("mean_ret", "up_rate", "mean_mfe", "mean_mae")])


@query("transition_gaps", _EVENTS + ", d AS (SELECT DISTINCT symbol, us FROM e), g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY symbol ORDER BY us)) / 1000.0::DOUBLE, -1) AS ms FROM d) SELECT e.symbol, e.us, side, type, ms AS ms_since_last FROM e JOIN g ON g.symbol = e.symbol AND g.us = e.us")
def transition_gaps(spark, d):
    return lq.since_last(_transitions(spark, d)).select("symbol", "us", "side", "type", "ms_since_last")


@query("transition_rates", _EVENTS + ", mm AS (SELECT symbol, (max(us) - min(us)) / 60e6 AS minutes FROM e GROUP BY 1) SELECT e.symbol, type, count(*) AS n, round(coalesce(count(*) / nullif(any_value(minutes), 0), 0), 10) AS per_minute FROM e JOIN mm ON mm.symbol = e.symbol GROUP BY 1, 2")
def transition_rates(spark, d):
    return lq.rates(_transitions(spark, d)).withColumn("per_minute", F.round("per_minute", 10))


@query("book_change_counts", f"WITH {_BOOK}, z AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY symbol, side, price ORDER BY us, seq), 0) AS was FROM k), a AS (SELECT symbol, {bucket_sql()} AS bucket, side, CASE WHEN q = 0 THEN CASE WHEN was > 0 THEN 'remove' END WHEN was = 0 THEN 'add' WHEN was <> q THEN 'modify' END AS action FROM z) SELECT symbol, bucket, " + ", ".join(f"count(*) FILTER (side = '{s}' AND action = '{a}') AS {s}_{n}" for s in ("bid", "ask") for n, a in (("added", "add"), ("removed", "remove"), ("updated", "modify"))) + " FROM a WHERE action IS NOT NULL GROUP BY 1, 2")
def book_change_counts(spark, d):
    changes = bk.level_changes(user_book(table(spark, d, "events")).drop("action"))
    return bk.change_counts(changes, STEP, START)


@query("executed_against_book", f"WITH {TRADES}, {QUOTES}, x AS (SELECT t.*, q.bid_price AS bid, q.ask_price AS ask FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.us > q.us) SELECT symbol, {bucket_sql()} AS bucket, CAST(coalesce(sum(price * quantity) FILTER (side = 'buy' AND price >= ask), 0) AS DOUBLE) AS bought, CAST(coalesce(sum(price * quantity) FILTER (side = 'sell' AND price <= bid), 0) AS DOUBLE) AS sold FROM x GROUP BY 1, 2")
def executed_against_book(spark, d):
    return doubles(bk.executed_against_book(trades(spark, d), quotes(spark, d), STEP, START), "bought", "sold")


@query("wall_formations")
def wall_formations(spark, d):
    rows = user_book(table(spark, d, "events"))
    return lq.walls(bk.book_states(rows, STEP, START).withColumnRenamed("bucket", "us"))


# ---- orders

_HOURLY = f"h AS (SELECT symbol, us - us % {HOUR} + {HOUR} AS us, CAST(arg_min(price, (us, seq)) AS DOUBLE) AS o, CAST(max(price) AS DOUBLE) AS h, CAST(min(price) AS DOUBLE) AS l, CAST(arg_max(price, (us, seq)) AS DOUBLE) AS c FROM t GROUP BY 1, us - us % {HOUR})"


def _hourly(spark, d):
    return doubles(b.time_bars(trades(spark, d), HOUR), "open", "high", "low", "close").withColumn("us", F.col("bar") + HOUR)


def _orders(spark, d):
    """Every trade places an order; limits and stops lie about its price."""
    p = F.col("price").cast("double")
    kinds = ("limit", "stop", "market", "stop_limit", "touched", "on_open", "on_close")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(F.col("seq") / 10) % 7 + 1).cast("int"))
    buy = F.floor(F.col("seq") / 70) % 2 == 0
    sign = F.when(buy, 1.0).otherwise(-1.0)
    return trades(spark, d).select(F.col("seq").alias("order_id"), "symbol", "us", F.when(buy, "buy").otherwise("sell").alias("side"), kind.alias("type"), (p - sign * 5).alias("limit"), (p + sign * 5).alias("stop"), (p - sign * 3).alias("touch"), F.lit(4.0).alias("trail"))


_LIMIT = f"""WITH {TRADES}, {_HOURLY}, o AS (SELECT seq AS order_id, symbol, us, seq // 70 % 2 = 0 AS buy, CAST(price AS DOUBLE) - CASE WHEN seq // 70 % 2 = 0 THEN 5 ELSE -5 END AS lim, CAST(price AS DOUBLE) + CASE WHEN seq // 70 % 2 = 0 THEN 5 ELSE -5 END AS stop, seq // 10 % 7 AS kind FROM t),
m AS (SELECT o.*, h.us AS bus, h.o, h.h, h.l, h.c FROM o JOIN h ON o.symbol = h.symbol AND h.us > o.us)"""


def _filled(spark, d, kind):
    return od.fill_orders(_orders(spark, d).where(F.col("type") == kind), _hourly(spark, d))


@query("limit_fill_first_touch", _LIMIT + ", f AS (SELECT *, CASE WHEN buy THEN CASE WHEN l < lim THEN least(h, lim) END ELSE CASE WHEN h > lim THEN greatest(l, lim) END END AS px FROM m WHERE kind = 0) SELECT order_id, min(bus) AS fill_us, round(arg_min(px, bus), 6) AS fill_price FROM f WHERE px IS NOT NULL GROUP BY 1")
def limit_fill_first_touch(spark, d):
    return _filled(spark, d, "limit").withColumn("fill_price", F.round("fill_price", 6))


@query("stop_fill", _LIMIT + ", f AS (SELECT *, CASE WHEN buy THEN CASE WHEN h > stop THEN greatest(stop, c) END ELSE CASE WHEN l < stop THEN least(stop, c) END END AS px FROM m WHERE kind = 1) SELECT order_id, min(bus) AS fill_us, round(arg_min(px, bus), 6) AS fill_price FROM f WHERE px IS NOT NULL GROUP BY 1")
def stop_fill(spark, d):
    return _filled(spark, d, "stop").withColumn("fill_price", F.round("fill_price", 6))


@query("market_fill", _LIMIT + " SELECT order_id, min(bus) AS fill_us, round(arg_min(c, bus), 6) AS fill_price FROM m WHERE kind = 2 GROUP BY 1")
def market_fill(spark, d):
    return _filled(spark, d, "market").withColumn("fill_price", F.round("fill_price", 6))


@query("stop_limit_fill", _LIMIT + ", g AS (SELECT *, bool_or(CASE WHEN buy THEN h > stop ELSE l < stop END) OVER (PARTITION BY order_id ORDER BY bus ROWS UNBOUNDED PRECEDING) AS latched FROM m WHERE kind = 3), f AS (SELECT *, CASE WHEN NOT latched THEN NULL WHEN buy THEN CASE WHEN c < lim THEN least(h, lim) END ELSE CASE WHEN c > lim THEN greatest(l, lim) END END AS px FROM g) SELECT order_id, min(bus) AS fill_us, round(arg_min(px, bus), 6) AS fill_price FROM f WHERE px IS NOT NULL GROUP BY 1")
def stop_limit_fill(spark, d):
    return _filled(spark, d, "stop_limit").withColumn("fill_price", F.round("fill_price", 6))


@query("touched_fill", _LIMIT + ", u AS (SELECT *, CASE WHEN buy THEN lim + 2 ELSE lim - 2 END AS touch FROM m WHERE kind = 4), g AS (SELECT *, bool_or(CASE WHEN buy THEN l <= touch ELSE h >= touch END) OVER (PARTITION BY order_id ORDER BY bus ROWS UNBOUNDED PRECEDING) AS latched FROM u) SELECT order_id, min(bus) AS fill_us, round(arg_min(lim, bus), 6) AS fill_price FROM g WHERE latched AND CASE WHEN buy THEN c <= lim ELSE c >= lim END GROUP BY 1")
def touched_fill(spark, d):
    return _filled(spark, d, "touched").withColumn("fill_price", F.round("fill_price", 6))


@query("open_close_fills", _LIMIT + " SELECT order_id, min(bus) AS fill_us, round(CASE WHEN any_value(kind) = 5 THEN arg_min(o, bus) ELSE arg_min(c, bus) END, 6) AS fill_price FROM m WHERE kind IN (5, 6) GROUP BY 1")
def open_close_fills(spark, d):
    return _filled(spark, d, "on_open").unionByName(_filled(spark, d, "on_close")).withColumn("fill_price", F.round("fill_price", 6))


@query("trailing_stops", _LIMIT + ", g AS (SELECT *, CASE WHEN buy THEN least(stop, min(c) OVER w + 4) ELSE greatest(stop, max(c) OVER w - 4) END AS now FROM m WINDOW w AS (PARTITION BY order_id ORDER BY bus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT order_id, min(bus) AS fill_us, round(arg_min(now, bus), 6) AS stop, round(arg_min(CASE WHEN buy THEN greatest(now, c) ELSE least(now, c) END, bus), 6) AS fill_price FROM g WHERE CASE WHEN buy THEN h >= now ELSE l <= now END GROUP BY 1")
def trailing_stops(spark, d):
    return od.trailing_fills(_orders(spark, d), _hourly(spark, d)).withColumns({c: F.round(c, 6) for c in ("stop", "fill_price")})


@query("combo_fills", f"""WITH {TRADES}, {_HOURLY}, o AS (SELECT seq AS combo_id, us, symbol AS s1, 'U' || CAST(CAST(substr(symbol, 2) AS BIGINT) // 2 AS VARCHAR) AS s2 FROM t),
m AS (SELECT combo_id, a.us AS bus, a.c - 0.5 * b.c AS net FROM o JOIN h a ON a.symbol = s1 AND a.us > o.us JOIN h b ON b.symbol = s2 AND b.us = a.us WHERE s1 <> s2)
SELECT combo_id, min(bus) AS fill_us, round(arg_min(net, bus), 6) AS net FROM m WHERE net <= 10 GROUP BY 1""")
def combo_fills(spark, d):
    """Each trade's user against half a unit of the user with half the number."""
    rows = trades(spark, d).withColumn("other", F.concat(F.lit("U"), F.floor(F.substring("symbol", 2, 9).cast("bigint") / 2))).where("symbol != other")
    legs = rows.select(F.col("seq").alias("combo_id"), "us", F.explode(F.array(F.struct(F.col("symbol"), F.lit(1.0).alias("ratio")), F.struct(F.col("other").alias("symbol"), F.lit(-0.5).alias("ratio")))).alias("l")).select("combo_id", "us", "l.*", F.lit(10.0).alias("limit"), F.lit(2).alias("n_legs"))
    return od.fill_combos(legs, _hourly(spark, d)).withColumn("net", F.round("net", 6))


@query("slippage_volume_share", f"WITH {TRADES} SELECT seq, round(pow(least(quantity / 200.0, 0.025), 2) * 0.1 * CAST(price AS DOUBLE), 10) AS slippage, round(greatest(CAST(price AS DOUBLE) * quantity * 7.5 / 10000 + quantity * 0.005, 0.35), 8) AS fee FROM t")
def slippage_volume_share(spark, d):
    rows = doubles(trades(spark, d), "price", "quantity")
    return rows.select("seq", F.round(od.volume_share_slippage(F.col("quantity"), F.lit(200.0), F.col("price")), 10).alias("slippage"), F.round(od.fee(F.col("quantity"), F.col("price"), 7.5, 0.005, 0.35), 8).alias("fee"))


@query("option_payoff", f"WITH {_CONTRACTS} SELECT id, round(CASE WHEN \"right\" = 'call' THEN greatest(spot - strike, 0) ELSE greatest(strike - spot, 0) END, 6) AS payoff FROM c")
def option_payoff(spark, d):
    return contracts(spark, d).select("id", F.round(od.option_payoff(F.col("right"), F.col("strike"), F.col("spot")), 6).alias("payoff"))


@query("strategy_payoffs", f"WITH {_CONTRACTS}, s AS (SELECT id, spot, strike AS k0, strike + 5 AS k1, strike + 10 AS k2, strike + 15 AS k3 FROM c) SELECT id, round(greatest(spot - k0, 0) - greatest(spot - k1, 0), 6) AS bull_call_spread, round(greatest(spot - k0, 0) + greatest(k0 - spot, 0), 6) AS straddle, round(greatest(spot - k0, 0) - 2 * greatest(spot - k1, 0) + greatest(spot - k2, 0), 6) AS butterfly_call, round(greatest(k0 - spot, 0) - greatest(k1 - spot, 0) - greatest(spot - k2, 0) + greatest(spot - k3, 0), 6) AS iron_condor FROM s")
def strategy_payoffs(spark, d):
    rows = contracts(spark, d)
    k = [F.col("strike") + 5 * i for i in range(4)]
    return rows.select("id", *[F.round(od.strategy_payoff(n, k, F.col("spot")), 6).alias(n) for n in ("bull_call_spread", "straddle", "butterfly_call", "iron_condor")])


@query("active_insights", f"WITH {TRADES}, i AS (SELECT seq, symbol, us, us + quantity * {HOUR} AS expires FROM t) SELECT symbol, count(*) FILTER (us <= {START + 15 * DAY} AND expires > {START + 15 * DAY}) AS active, count(*) FILTER (expires <= {START + 15 * DAY}) AS expired, min(expires) FILTER (expires > {START + 15 * DAY}) AS next_expiry FROM i GROUP BY 1")
def active_insights(spark, d):
    now = START + 15 * DAY
    rows = trades(spark, d).select("symbol", "us", (F.col("us") + F.col("quantity").cast("bigint") * HOUR).alias("expires"))
    return od.active_insights(rows, now)


# ---- scalar functions


@query("scalar_math", "SELECT o_orderkey, floor(p / 0.05 + 0.5) * 0.05 AS to_step, trunc(p * 10) / 10 AS cut, CAST(o_orderkey AS DOUBLE) / nullif(o_custkey % 3, 0) AS ratio FROM (SELECT *, CAST(o_totalprice AS DOUBLE) AS p FROM orders)".replace("CAST(o_orderkey AS DOUBLE) / nullif(o_custkey % 3, 0) AS ratio", "round(coalesce(CAST(o_orderkey AS DOUBLE) / nullif(o_custkey % 3, 0), 0), 6) AS ratio").replace("floor(p / 0.05 + 0.5) * 0.05 AS to_step, trunc(p * 10) / 10 AS cut", "round(round(p / 0.05) * 0.05, 6) AS to_step, round(trunc(p * 10) / 10, 6) AS cut"))
def scalar_math(spark, d):
    p = F.col("o_totalprice").cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.round(sc.round_to(p, 0.05), 6).alias("to_step"), F.round(sc.truncate(p, 1), 6).alias("cut"), F.round(sc.safe_divide(F.col("o_orderkey"), F.col("o_custkey") % 3), 6).alias("ratio"))


@query("scalar_dates", f"WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders) SELECT o_orderkey, dayofweek(dt) NOT IN (0, 6) AS business, CAST(date_trunc('week', dt) AS DATE) + 7 AS week_end, CAST(date_trunc('month', dt) + INTERVAL 1 MONTH AS DATE) AS month_end, CAST(date_trunc('quarter', dt) + INTERVAL 3 MONTH AS DATE) AS quarter_end, CAST(date_trunc('year', dt) + INTERVAL 1 YEAR AS DATE) AS year_end, dt + CAST(CASE dayofweek(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) AS next_business FROM o")
def scalar_dates(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"))
    return rows.select("o_orderkey", sc.is_business_day(F.col("dt")).alias("business"), sc.end_of_week(F.col("dt")).alias("week_end"), sc.end_of_month(F.col("dt")).alias("month_end"), sc.end_of_quarter(F.col("dt")).alias("quarter_end"), sc.end_of_year(F.col("dt")).alias("year_end"), sc.next_business_day(F.col("dt")).alias("next_business"))


@query("scalar_times", f"WITH {TRADES} SELECT seq, us - us % {HOUR} AS down, -((-us) // {HOUR}) * {HOUR} AS plain FROM t".replace(f"-((-us) // {HOUR}) * {HOUR} AS plain", f"us + ({HOUR} - us % {HOUR}) % {HOUR} AS up, (us + {HOUR // 2}) - (us + {HOUR // 2}) % {HOUR} AS near, regexp_replace(lower('A-b_C/' || symbol), '[-_/]', '', 'g') AS ticker"))
def scalar_times(spark, d):
    return trades(spark, d).select("seq", sc.floor_time(F.col("us"), HOUR).alias("down"), sc.ceil_time(F.col("us"), HOUR).alias("up"), sc.round_time(F.col("us"), HOUR).alias("near"), sc.plain_ticker(F.concat(F.lit("A-b_C/"), "symbol")).alias("ticker"))


# ---- experiments


def _tradeable(spark, d):
    rows = ft.feature_rows(observed(spark, d), {"trade_flow": {}, "mid_price": {}}, ("close_price",))
    return rows.withColumn("close", F.col("mid_price"))


@query("position_experiment")
def position_experiment(spark, d):
    return pf.position_experiment(_tradeable(spark, d), {"entry": "trade_flow < 0", "exit": "trade_flow > 0", "fraction": "0.1", "fee_bps": "5", "min_hold": str(STEP), "max_hold": str(4 * DAY)})


class Crossover:
    """A script: buy when the short mean of closes rises above the long one, close when it falls below."""

    def initialize(self) -> None:
        self.closes: list[float] = []

    def on_observation(self, row: dict):
        self.closes = [*self.closes[-19:], row["price"]]
        if len(self.closes) < 20:
            return None
        short, long = sum(self.closes[-5:]) / 5, sum(self.closes) / 20
        return "buy" if short > long * 1.02 else "close" if short < long else None


class Momentum:
    """A script that emits values instead of orders."""

    def initialize(self) -> None:
        self.last: float | None = None

    def on_observation(self, row: dict):
        out = {"momentum": row["price"] - self.last} if self.last is not None else None
        self.last = row["price"]
        return out


@query("script_trade")
def script_trade(spark, d):
    return pf.run_strategy(_tradeable(spark, d), Crossover, ("trade_flow",), trade=True, fee_bps="2")


@query("python_strategy", f"WITH {OBS}, p AS (SELECT symbol, bucket, CAST(coalesce(last, 0) AS DOUBLE) AS v FROM obs), m AS (SELECT symbol, bucket, v - lag(v) OVER (PARTITION BY symbol ORDER BY bucket) AS x FROM p) SELECT symbol, bucket AS at, 'momentum' AS reason, round(x, 6) AS value FROM m WHERE x IS NOT NULL")
def python_strategy(spark, d):
    return pf.run_strategy(_tradeable(spark, d), Momentum, ()).select("symbol", "at", "reason", F.round("value", 6).alias("value"))


@query("composite_experiment")
def composite_experiment(spark, d):
    rows = _tradeable(spark, d)
    return pf.composite({"position": pf.position_experiment(rows, {"entry": "trade_flow < 0", "max_hold": str(DAY)}), "script": pf.run_strategy(rows, Momentum, ())})


# ---- streams, sources and sinks


def _event_stream(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"), F.col("value").cast("decimal(18,8)").alias("price"), (1 + k % 10).cast("decimal(18,8)").alias("quantity"))


@query("stream_live_bars", f"WITH {TRADES}, g AS (SELECT symbol, us - us % {DAY} AS bar, CAST(arg_max(price, (us, seq)) AS DOUBLE) AS close, CAST(sum(quantity) AS DOUBLE) AS volume, count(*) AS n FROM t GROUP BY 1, 2) SELECT * FROM g WHERE bar + {DAY} <= (SELECT max(us) FROM t) // 1000 * 1000")
def stream_live_bars(spark, d):
    """Bars of a stream that are closed once all has been read: those before the last event's."""
    at = fresh_dir(spark, "stream")
    live.run_now(live.live_bars(_event_stream(spark, d), DAY), at)
    return doubles(spark.read.parquet(f"{at}/out"), "close", "volume").select("symbol", "bar", "close", "volume", "n")


@query("stream_live_state", f"WITH {TRADES}, b AS (SELECT symbol, {bucket_sql(step=DAY)} AS bucket, count(*) AS n, sum(quantity) AS q, arg_max(price, (us, seq)) AS p FROM t GROUP BY 1, 2), r AS (SELECT symbol, bucket, CAST(p AS DOUBLE) AS last, CAST(sum(q) OVER w AS DOUBLE) AS volume, CAST(sum(n) OVER w AS BIGINT) AS trades, 0 AS late, max(bucket) OVER (PARTITION BY symbol) AS newest FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING)) SELECT symbol, bucket, last, volume, trades, late FROM r WHERE bucket < newest")
def stream_live_state(spark, d):
    at = fresh_dir(spark, "stream")
    live.run_now(live.live_state(_event_stream(spark, d), START, DAY), at)
    return spark.read.parquet(f"{at}/out")


@query("staged_feed_roundtrip", "SELECT symbol, venue, count(*) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, CAST(sum(coalesce(price, 0)) AS DOUBLE) AS sum_price FROM trades WHERE timestamp_ms IS NOT NULL GROUP BY 1, 2")
def staged_feed_roundtrip(spark, d):
    """Trades written as staged CSV and read back by the feed's reader."""
    at = fresh_dir(spark, "feed")
    table(spark, d, "trades").select("timestamp_ms", "price", "size", "side", "trade_id", "symbol", "venue").write.option("header", True).partitionBy("symbol", "venue").csv(at)
    rows = feeds.staged_csv(spark, at, "trades", folders=("symbol", "venue"))
    ends = feeds.staged_bounds(rows, ["symbol", "venue"])
    return ends.join(rows.groupBy("symbol", "venue").agg(F.sum("price").cast("double").alias("sum_price")), ["symbol", "venue"])


@query("feed_quote_bars", f"SELECT symbol, venue, timestamp_ms * 1000 - timestamp_ms * 1000 % {HOUR} AS bar, count(*) AS n, CAST(max(bid_price) AS DOUBLE) AS bid_high, CAST(min(ask_price) AS DOUBLE) AS ask_low FROM quotes WHERE bid_price > 0 AND ask_price > 0 GROUP BY 1, 2, 3")
def feed_quote_bars(spark, d):
    rows = table(spark, d, "quotes").where("bid_price > 0 AND ask_price > 0")
    ev = feeds.feed_events(rows, "quotes", F.col("symbol"), F.col("venue"))
    return ev.groupBy("symbol", "venue", (F.col("us") - F.pmod("us", F.lit(HOUR))).alias("bar")).agg(F.count("*").alias("n"), F.max("bid_price").cast("double").alias("bid_high"), F.min("ask_price").cast("double").alias("ask_low"))


@query("sink_compare", "SELECT 0 AS n_different")
def sink_compare(spark, d):
    """A run saved and read again has the rows that went in."""
    rows = doubles(b.time_bars(trades(spark, d), DAY), "open", "high", "low", "close", "volume")
    at = fresh_dir(spark, "run")
    sinks.save_run(spark, at, JOB, {"bars": rows})
    back = spark.read.parquet(f"{at}/{JOB.hash()[:16]}/bars")
    return sinks.compare_runs(rows, back).agg(F.count("*").cast("int").alias("n_different"))


@query("job_run", f"WITH {OBS} SELECT 'observations' AS name, quality AS kind, count(*) AS n FROM obs GROUP BY 2 UNION ALL SELECT 'hypothesis', h, count(*) FROM (SELECT symbol, CAST(unnest([1, 3]) AS INT) AS h, buy - sell AS flow, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) - 1 AS ahead, coalesce(last, 0) AS mid FROM obs) WHERE flow < 0 AND ahead >= h AND mid <> 0 GROUP BY 2")
def job_run(spark, d):
    """A job document run from end to end, and its tables read back."""
    events = trades(spark, d)
    symbols = sorted(r[0] for r in table(spark, d, "events").select(F.concat(F.lit("U"), "user_id")).distinct().collect())
    at = lambda us: datetime.fromtimestamp(us / 1e6, timezone.utc).isoformat()
    job = {"jobId": "flow", "symbols": symbols, "startTime": at(START), "endTime": at(END), "observationInterval": "6h", "features": ["mid_price", "trade_flow", "spread_bps"], "rawFields": ["volume", "vwap"], "experimentName": "hypothesis", "experimentConfig": {"condition": "trade_flow < 0", "horizons": "1,3", "direction": "up"}}
    done = runner.run_job(spark, json.dumps(job), events, fresh_dir(spark, "jobs"))
    seen = spark.read.parquet(f"{done['path']}/observations").groupBy("data_quality").agg(F.count("*").alias("n"))
    tests = spark.read.parquet(f"{done['path']}/hypothesis")
    return seen.select(F.lit("observations").alias("name"), F.col("data_quality").cast("int").alias("kind"), "n").unionByName(tests.select(F.lit("hypothesis").alias("name"), F.col("horizon").cast("int").alias("kind"), "n"))


@query("synthetic_stream")
def synthetic_stream(spark, d):
    return feeds.synthetic_events(spark, 100_000).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.avg(F.coalesce("price", "bid_price").cast("double")).alias("mean_price"))
