"""Queries of events, grids, features, labels and joins by time, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import asof as a
from quern.operators import events as e
from quern.operators import features as f
from quern.operators import grid as g
from quern.operators import labels as lb
from quern.operators.running import ranked
from quern.plans.job import Condition, JobSpec, micros
from quern.shards import plan_shards
from quern.tables import table

START, END = micros("2024-01-01"), micros("2024-01-31")
HOUR = 3_600_000_000
STEP = 6 * HOUR
JOB = JobSpec(start=START, end=END, step=STEP)
QUERIES: dict = {}
SQL: dict[str, str] = {}

TRADES = """t AS (
  SELECT 'U' || user_id AS symbol, epoch_us(ts) AS us, event_id AS seq, CAST(value AS DECIMAL(18,8)) AS price, 1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS quantity,
         CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' ELSE 'unknown' END AS side FROM events)"""
QUOTES = """q AS (
  SELECT 'U' || user_id AS symbol, epoch_us(ts) AS us, event_id AS seq, CAST(value AS DECIMAL(18,8)) - 0.05 AS bid_price, CAST(value AS DECIMAL(18,8)) + 0.05 AS ask_price,
         1 + k % 7 AS bid_size, 1 + (k // 7) % 7 AS ask_size
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) WHERE event_type IN ('view', 'click') AND value > 0.05)"""
W_SEL = f"us BETWEEN {START} AND {END}"


def bucket_sql(us: str = "us", step: int = STEP) -> str:
    return f"greatest({START}, {START} + (({us} - {START} + {step - 1}) // {step}) * {step})"


#: Observations of trades on the grid, gaps filled, state carried.
OBS = f"""{TRADES}, b AS (
  SELECT symbol, {bucket_sql()} AS bucket, count(*) AS n, sum(quantity) AS vol, arg_min(price, (us, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (us, seq)) AS c,
         sum(price * quantity) AS notional, coalesce(sum(price * quantity) FILTER (side = 'buy'), 0) AS buy, coalesce(sum(price * quantity) FILTER (side = 'sell'), 0) AS sell,
         coalesce(sum(quantity) FILTER (side = 'buy'), 0) - coalesce(sum(quantity) FILTER (side = 'sell'), 0) AS signed, max(us) AS last_us
  FROM t WHERE {W_SEL} GROUP BY 1, 2
), grid AS (SELECT symbol, x.b AS bucket FROM (SELECT DISTINCT symbol FROM t WHERE {W_SEL}) s, unnest(range({START}, {END} + 1, {STEP})) AS x(b)),
j AS (SELECT coalesce(grid.symbol, b.symbol) AS symbol, coalesce(grid.bucket, b.bucket) AS bucket, b.* EXCLUDE (symbol, bucket) FROM grid FULL JOIN b ON grid.symbol = b.symbol AND grid.bucket = b.bucket),
obs AS (
  SELECT symbol, bucket, coalesce(n, 0) AS n, coalesce(vol, 0) AS vol, coalesce(o, 0) AS o, coalesce(h, 0) AS h, coalesce(l, 0) AS l, c, coalesce(notional, 0) AS notional, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, coalesce(signed, 0) AS signed,
         last_value(c IGNORE NULLS) OVER w AS last, max(last_us) OVER w AS last_us, sum(coalesce(signed, 0)) OVER w AS cumulative,
         CASE WHEN n > 0 THEN 2 WHEN max(last_us) OVER w IS NOT NULL THEN 1 ELSE 0 END AS quality
  FROM j WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING)
)"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def trades(spark: SparkSession, d: str) -> DataFrame:
    return e.user_trades(table(spark, d, "events"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return e.user_quotes(table(spark, d, "events"))


def observed(spark: SparkSession, d: str, job: JobSpec = JOB) -> DataFrame:
    return g.observations(e.select_events(trades(spark, d), job), job)


def observed_both(spark: SparkSession, d: str, job: JobSpec = JOB) -> DataFrame:
    return g.observations(e.select_events(e.unified([trades(spark, d), quotes(spark, d)]), job), job)


@query("event_union_order", f"WITH {TRADES}, {QUOTES}, u AS (SELECT symbol, us, seq, 0 AS stream FROM t UNION ALL SELECT symbol, us, seq, 1 FROM q) SELECT symbol, us, seq, stream, row_number() OVER (PARTITION BY symbol ORDER BY us, seq, stream) AS place FROM u")
def event_union_order(spark, d):
    rows = e.unified([trades(spark, d), quotes(spark, d)])
    return ranked(rows.select("symbol", "us", "seq", "stream"), ["symbol"], "us", ["seq", "stream"], "place")


@query("filter_window_types", f"WITH {TRADES} SELECT symbol, us, seq, price FROM t WHERE symbol IN ('U1', 'U2', 'U3') AND us BETWEEN {START + 5 * 24 * HOUR} AND {START + 20 * 24 * HOUR}")
def filter_window_types(spark, d):
    job = replace(JOB, symbols=("U1", "U2", "U3"), start=START + 5 * 24 * HOUR, end=START + 20 * 24 * HOUR, event_types=("bar",))
    return e.select_events(e.unified([trades(spark, d), quotes(spark, d)]), job).select("symbol", "us", "seq", "price")


@query("first_events", f"WITH {TRADES} SELECT symbol, us, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us, seq) AS n FROM t WHERE {W_SEL}) WHERE n <= 7")
def first_events(spark, d):
    return e.select_events(trades(spark, d), replace(JOB, max_events=7)).select("symbol", "us", "seq")


@query("grid_ceil_bars", f"WITH {OBS} SELECT symbol, bucket, n AS trade_count, CAST(vol AS DOUBLE) AS volume, CAST(notional AS DOUBLE) AS notional FROM obs WHERE n > 0")
def grid_ceil_bars(spark, d):
    rows = observed(spark, d, replace(JOB, fill_forward=False))
    return rows.select("symbol", "bucket", "trade_count", F.col("trade_volume").cast("double").alias("volume"), F.col("notional").cast("double").alias("notional"))


@query("grid_gapfill_locf", f"WITH {OBS} SELECT symbol, bucket, quality AS data_quality, CAST(last AS DOUBLE) AS last, round(coalesce((bucket - last_us) / 1000.0, -1), 3) AS data_age_ms FROM obs")
def grid_gapfill_locf(spark, d):
    return observed(spark, d).select("symbol", "bucket", "data_quality", F.col("last").cast("double").alias("last"), F.round("data_age_ms", 3).alias("data_age_ms"))


@query("grid_quality_counts", f"WITH {OBS} SELECT symbol, quality AS data_quality, count(*) AS n FROM obs GROUP BY 1, 2")
def grid_quality_counts(spark, d):
    return observed(spark, d).groupBy("symbol", "data_quality").agg(F.count("*").alias("n"))


@query("grid_first_observations", f"WITH {OBS} SELECT symbol, bucket, n AS trade_count FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS r FROM obs) WHERE r <= 10")
def grid_first_observations(spark, d):
    return observed(spark, d, replace(JOB, max_observations=10)).select("symbol", "bucket", "trade_count")


@query("event_driven_obs", f"WITH {TRADES} SELECT symbol, us AS bucket, seq, CAST(price AS DOUBLE) AS last, CAST(sum(quantity) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS volume FROM t WHERE {W_SEL}")
def event_driven_obs(spark, d):
    return observed(spark, d, replace(JOB, step=None)).select("symbol", "bucket", "seq", F.col("last").cast("double").alias("last"), F.col("volume").cast("double").alias("volume"))


@query("grid_legacy_floor", f"WITH {TRADES} SELECT symbol, us - us % {STEP} AS bucket, count(*) AS trade_count, CAST(arg_max(price, (us, seq)) AS DOUBLE) AS close FROM t GROUP BY 1, 2")
def grid_legacy_floor(spark, d):
    return g.floor_grid(trades(spark, d), STEP).select("symbol", "bucket", "trade_count", F.col("close_at").cast("double").alias("close"))


@query("replay_statistics", f"WITH {TRADES}, r AS (SELECT *, {bucket_sql()} AS b FROM t WHERE {W_SEL}), l AS (SELECT *, coalesce(b < max(b) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM r) SELECT symbol, count(*) AS n_events, count(*) FILTER (late) AS n_late, count(DISTINCT b) AS n_buckets, {(END - START) // STEP + 1} - count(DISTINCT b) AS n_empty FROM l GROUP BY 1")
def replay_statistics(spark, d):
    return g.replay_statistics(e.select_events(trades(spark, d), JOB), JOB)


@query("period_ohlc_vwap", f"WITH {OBS} SELECT symbol, bucket, CAST(o AS DOUBLE) AS open_price, CAST(h AS DOUBLE) AS high_price, CAST(l AS DOUBLE) AS low_price, CAST(coalesce(c, 0) AS DOUBLE) AS close_price, round(CASE WHEN vol > 0 THEN CAST(notional AS DOUBLE) / vol ELSE 0 END, 8) AS vwap FROM obs")
def period_ohlc_vwap(spark, d):
    rows = f.feature_rows(observed(spark, d), {}, ("open_price", "high_price", "low_price", "close_price", "vwap"))
    return rows.withColumn("vwap", F.round("vwap", 8)).drop("data_quality", "data_age_ms")


@query("trade_flow_features", f"WITH {OBS} SELECT symbol, bucket, round(CAST(buy - sell AS DOUBLE), 6) AS trade_flow, round(CAST(buy - sell AS DOUBLE), 6) AS net_flow, round(CAST(buy AS DOUBLE), 6) AS aggressive_buy_volume, round(CAST(sell AS DOUBLE), 6) AS aggressive_sell_volume, CAST(n AS DOUBLE) AS trade_intensity, CAST(vol AS DOUBLE) AS trade_volume FROM obs")
def trade_flow_features(spark, d):
    names = ("trade_flow", "net_flow", "aggressive_buy_volume", "aggressive_sell_volume", "trade_intensity", "trade_volume")
    rows = f.feature_rows(observed(spark, d), {n: {} for n in names})
    return rows.select("symbol", "bucket", *[F.round(n, 6).alias(n) for n in names])


@query("cumulative_flow", f"WITH {OBS} SELECT symbol, bucket, CAST(cumulative AS DOUBLE) AS cumulative_flow FROM obs")
def cumulative_flow(spark, d):
    return f.feature_rows(observed(spark, d), {"cumulative_flow": {}}).select("symbol", "bucket", "cumulative_flow")


_BOTH = f"""{TRADES}, {QUOTES}, u AS (SELECT symbol, us, seq, 0 AS stream, price, NULL AS bid_price, NULL AS ask_price, NULL AS bid_size, NULL AS ask_size FROM t UNION ALL SELECT symbol, us, seq, 1, NULL, bid_price, ask_price, bid_size, ask_size FROM q),
ub AS (
  SELECT symbol, {bucket_sql()} AS bucket, arg_max(price, (us, seq, stream)) FILTER (price IS NOT NULL) AS price, arg_max(bid_price, (us, seq)) FILTER (bid_price > 0) AS bid, arg_max(ask_price, (us, seq)) FILTER (ask_price > 0) AS ask,
         arg_max(bid_size, (us, seq)) FILTER (bid_price > 0) AS bs, arg_max(ask_size, (us, seq)) FILTER (ask_price > 0) AS az
  FROM u WHERE {W_SEL} GROUP BY 1, 2
), ug AS (SELECT symbol, x.b AS bucket FROM (SELECT DISTINCT symbol FROM u WHERE {W_SEL}) s, unnest(range({START}, {END} + 1, {STEP})) AS x(b)),
st AS (
  SELECT coalesce(ug.symbol, ub.symbol) AS symbol, coalesce(ug.bucket, ub.bucket) AS bucket, price, bid, ask, bs, az FROM ug FULL JOIN ub ON ug.symbol = ub.symbol AND ug.bucket = ub.bucket
), state AS (
  SELECT symbol, bucket, CAST(coalesce(last_value(price IGNORE NULLS) OVER w, 0) AS DOUBLE) AS last, CAST(coalesce(last_value(bid IGNORE NULLS) OVER w, 0) AS DOUBLE) AS bid, CAST(coalesce(last_value(ask IGNORE NULLS) OVER w, 0) AS DOUBLE) AS ask,
         CAST(coalesce(last_value(bs IGNORE NULLS) OVER w, 0) AS DOUBLE) AS bs, CAST(coalesce(last_value(az IGNORE NULLS) OVER w, 0) AS DOUBLE) AS az
  FROM st WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING)
), m AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE last END AS mid, CASE WHEN bid > 0 AND ask > 0 THEN ask - bid ELSE 0 END AS spread, bs + az AS depth FROM state)"""


@query("quote_state_locf", f"WITH {_BOTH} SELECT symbol, bucket, round(mid, 8) AS mid_price, round(spread, 8) AS spread, round(CASE WHEN mid > 0 THEN spread / mid * 10000 ELSE 0 END, 6) AS spread_bps, bid AS bid_price, ask AS ask_price FROM m")
def quote_state_locf(spark, d):
    rows = f.feature_rows(observed_both(spark, d), {"mid_price": {}, "spread": {}, "spread_bps": {}}, ("bid_price", "ask_price"))
    return rows.select("symbol", "bucket", F.round("mid_price", 8).alias("mid_price"), F.round("spread", 8).alias("spread"), F.round("spread_bps", 6).alias("spread_bps"), "bid_price", "ask_price")


@query("imbalance_features", f"WITH {_BOTH} SELECT symbol, bucket, depth, bs AS bid_depth, az AS ask_depth, round(CASE WHEN depth > 0 THEN (bs - az) / depth ELSE 0 END, 8) AS imbalance, round(CASE WHEN az > 0 THEN bs / az ELSE 0 END, 8) AS depth_ratio FROM m")
def imbalance_features(spark, d):
    names = ("depth", "bid_depth", "ask_depth", "imbalance", "depth_ratio")
    return f.feature_rows(observed_both(spark, d), {n: {} for n in names}).select("symbol", "bucket", *[F.round(n, 8).alias(n) for n in names])


_BAND = "CASE WHEN bid > 0 AND bid >= mid * (1 - {bps} / 10000.0) THEN bs ELSE 0 END + CASE WHEN ask > 0 AND ask <= mid * (1 + {bps} / 10000.0) THEN az ELSE 0 END"


@query("depletion_lag", f"WITH {_BOTH}, x AS (SELECT *, {_BAND.format(bps=100)} AS band FROM m) SELECT symbol, bucket, round(CASE WHEN row_number() OVER w <= 2 THEN 0 ELSE band - coalesce(lag(band, 4) OVER w, first_value(band) OVER w) END, 8) AS liquidity_depletion FROM x WINDOW w AS (PARTITION BY symbol ORDER BY bucket)")
def depletion_lag(spark, d):
    return f.feature_rows(observed_both(spark, d), {"liquidity_depletion": {"lookback": "3", "bps": "100"}}).select("symbol", "bucket", F.round("liquidity_depletion", 8).alias("liquidity_depletion"))


@query("replenishment_rate", f"WITH {_BOTH}, x AS (SELECT *, {_BAND.format(bps=100)} AS band FROM m) SELECT symbol, bucket, round(CASE WHEN count(*) OVER w >= 2 THEN (last_value(band) OVER w - first_value(band) OVER w) / count(*) OVER w ELSE 0 END, 8) AS replenishment_rate FROM x WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def replenishment_rate(spark, d):
    return f.feature_rows(observed_both(spark, d), {"replenishment_rate": {"bps": "100"}}).select("symbol", "bucket", F.round("replenishment_rate", 8).alias("replenishment_rate"))


@query("depth_persistence", f"WITH {_BOTH} SELECT symbol, bucket, round(CASE WHEN count(*) OVER w < 2 THEN 1 WHEN avg(depth) OVER w = 0 THEN 0 ELSE greatest(0, 1 - stddev_pop(depth) OVER w / avg(depth) OVER w) END, 6) AS depth_persistence FROM m WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def depth_persistence(spark, d):
    return f.feature_rows(observed_both(spark, d), {"depth_persistence": {}}).select("symbol", "bucket", F.round("depth_persistence", 6).alias("depth_persistence"))


@query("structural_features")
def structural_features(spark, d):
    """Features over the levels of a full book: in-band imbalance, walls, resistance."""
    from quern.operators.book import book_states

    states = book_states(e.unified([e.user_book(table(spark, d, "events")), quotes(spark, d)]), STEP, START)
    rows = states.select("symbol", "bucket", F.col("best_bid").alias("bid_price"), F.col("best_ask").alias("ask_price"), F.lit(None).cast("double").alias("last"), F.lit(2).alias("data_quality"), F.lit(0.0).alias("data_age_ms"), *[F.transform(s, lambda x: F.struct(x["price"].cast("double").alias("p"), x["quantity"].cast("double").alias("q"))).alias(s) for s in ("bids", "asks")])
    rows = rows.withColumn("mid_price", f.REGISTRY["mid_price"].build({}))
    cols = {n: f.REGISTRY[n] for n in ("structural_imbalance", "liquidity_wall", "resistance")}
    return rows.select("symbol", "bucket", *[F.round(x.build(dict(x.defaults) | ({"bps": 2000} if n == "structural_imbalance" else {})), 6).alias(n) for n, x in cols.items()])


@query("raw_fields_projection", f"WITH {OBS} SELECT symbol, bucket, CAST(vol AS DOUBLE) AS volume, n AS trade_count, CAST(coalesce(last, 0) AS DOUBLE) AS last_price FROM obs")
def raw_fields_projection(spark, d):
    return f.feature_rows(observed(spark, d), {}, ("volume", "trade_count", "last_price")).drop("data_quality", "data_age_ms")


@query("condition_rows", f"WITH {OBS} SELECT symbol, bucket FROM obs WHERE CAST(buy - sell AS DOUBLE) < -50")
def condition_rows(spark, d):
    rows = f.feature_rows(observed(spark, d), {"trade_flow": {}})
    return rows.where(Condition.parse("trade_flow < -5e1").column(rows.columns)).select("symbol", "bucket")


#: Rows of trades as an irregular series, and those of the grid as a regular one.
_LABELS = f"WITH {OBS}, s AS (SELECT symbol, bucket, CAST(last AS DOUBLE) AS p FROM obs WHERE last IS NOT NULL)"


def _series(spark, d):
    return observed(spark, d).where(F.col("last").isNotNull()).select("symbol", "bucket", F.col("last").cast("double").alias("p"))


@query("label_n_obs", _LABELS + " SELECT symbol, bucket, " + ", ".join(f"round(lead(p, {n}) OVER w / nullif(p, 0) - 1, 8) AS ret_{n}" for n in (1, 5, 20)) + " FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bucket)")
def label_n_obs(spark, d):
    return lb.label_by_count(_series(spark, d), "p", (1, 5, 20)).select("symbol", "bucket", *[F.round(f"ret_{n}", 8).alias(f"ret_{n}") for n in (1, 5, 20)])


@query("label_time_horizon", f"WITH {TRADES}, s AS (SELECT symbol, us, seq, CAST(price AS DOUBLE) AS p FROM t) SELECT s.symbol, s.us, x.us AS observed_at, round(x.p / nullif(s.p, 0) - 1, 8) AS ret FROM s ASOF JOIN s x ON s.symbol = x.symbol AND s.us + {4 * HOUR} <= x.us")
def label_time_horizon(spark, d):
    rows = trades(spark, d).select("symbol", "us", F.col("price").cast("double").alias("p"))
    return lb.label_after(rows, "p", 4 * HOUR, "us").select("symbol", "us", "observed_at", F.round("ret", 8).alias("ret"))


@query("label_forced", f"WITH {TRADES}, s AS (SELECT symbol, us, CAST(price AS DOUBLE) AS p, lead(us, 3) OVER (PARTITION BY symbol ORDER BY us) AS cap FROM t), d AS (SELECT *, least(us + {24 * HOUR}, cap) AS due FROM s) SELECT d.symbol, d.us, x.us AS observed_at, round(x.p / nullif(d.p, 0) - 1, 8) AS ret FROM d ASOF JOIN s x ON d.symbol = x.symbol AND d.due <= x.us")
def label_forced(spark, d):
    rows = trades(spark, d).select("symbol", "us", F.col("price").cast("double").alias("p"))
    return lb.label_after(rows, "p", 24 * HOUR, "us", cap=3).select("symbol", "us", "observed_at", F.round("ret", 8).alias("ret"))


@query("mfe_mae", _LABELS + f" SELECT symbol, bucket, round(max(p) OVER w / nullif(p, 0) - 1, 8) AS mfe, round(min(p) OVER w / nullif(p, 0) - 1, 8) AS mae FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN 1 FOLLOWING AND {24 * HOUR} FOLLOWING)")
def mfe_mae(spark, d):
    return lb.excursions(_series(spark, d), "p", 24 * HOUR).select("symbol", "bucket", F.round("mfe", 8).alias("mfe"), F.round("mae", 8).alias("mae"))


_HYPOTHESIS = f"WITH {OBS}, s AS (SELECT symbol, bucket, CAST(coalesce(last, 0) AS DOUBLE) AS p, CAST(buy - sell AS DOUBLE) < 0 AS hit FROM obs), r AS (SELECT *, " + ", ".join(f"lead(p, {n}) OVER w / nullif(p, 0) - 1 AS r{n}" for n in (1, 5, 20)) + " FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bucket)), u AS (" + " UNION ALL ".join(f"SELECT {n} AS horizon, r{n} AS ret FROM r WHERE hit" for n in (1, 5, 20)) + ")"


@query("hypothesis_metrics", _HYPOTHESIS + " SELECT horizon, count(*) AS n, round(avg(ret), 8) AS mean_return, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS up_rate, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS continuation_rate FROM u WHERE ret IS NOT NULL GROUP BY 1")
def hypothesis_metrics(spark, d):
    """Flagship: does selling pressure come before rises?"""
    rows = f.feature_rows(observed(spark, d), {"trade_flow": {}, "mid_price": {}})
    return lb.hypothesis(rows, Condition.parse("trade_flow < 0").column(rows.columns), "mid_price", (1, 5, 20))


@query("drift_report", _HYPOTHESIS + ", a AS (" + " UNION ALL ".join(f"SELECT {n} AS horizon, hit, r{n} AS ret FROM r" for n in (1, 5, 20)) + ") SELECT horizon, hit, count(*) AS n, round(avg(ret), 8) AS mean_return, round(quantile_cont(ret, 0.5), 8) AS median_return, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM a WHERE ret IS NOT NULL GROUP BY 1, 2")
def drift_report(spark, d):
    """Forward drift of triggered rows against all others."""
    rows = f.feature_rows(observed(spark, d), {"trade_flow": {}, "mid_price": {}})
    got = lb.drift_report(rows, F.col("trade_flow") < 0, "mid_price", (1, 5, 20))
    return got.select("horizon", "hit", "n", *[F.round(c, p).alias(c) for c, p in (("mean_return", 8), ("median_return", 8), ("hit_rate", 6))])


# ---- joins


@query("asof_quote_at_trade", f"WITH {TRADES}, {QUOTES}, o AS (SELECT * FROM t) SELECT o.symbol, o.us, o.seq, CAST(q.bid_price AS DOUBLE) AS bid_price, CAST(q.ask_price AS DOUBLE) AS ask_price FROM o ASOF LEFT JOIN q ON o.symbol = q.symbol AND o.us >= q.us")
def asof_quote_at_trade(spark, d):
    probes = trades(spark, d).select("symbol", "us", "seq")
    facts = quotes(spark, d).select("symbol", F.col("us").alias("at"), F.col("seq").alias("tie"), F.col("bid_price").cast("double").alias("bid_price"), F.col("ask_price").cast("double").alias("ask_price"))
    plan = plan_shards(facts, ["symbol"], "at")
    return a.asof(probes, facts, ["symbol"], "us", "at", ["bid_price", "ask_price"], tie="tie", plan=plan)


@query("cross_venue_spread", """
WITH o AS (SELECT symbol, venue, "timestamp" AS at, avg((bid + ask) / 2)::DOUBLE AS mid FROM observations WHERE bid > 0 AND ask > 0 GROUP BY 1, 2, 3)
SELECT a.symbol, epoch_us(a.at) AS at_us, a.venue AS venue_a, b.venue AS venue_b, round((b.mid - a.mid) / a.mid * 10000, 4) AS premium_bps
FROM o a JOIN o b ON a.symbol = b.symbol AND a.at = b.at AND a.venue < b.venue""")
def cross_venue_spread(spark, d):
    """Venues compared at the grid times they share; each symbol has few venues at one time."""
    rows = table(spark, d, "observations").where("bid > 0 AND ask > 0").groupBy("symbol", "venue", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at_us")).agg(F.avg((F.col("bid").cast("double") + F.col("ask").cast("double")) / 2).alias("mid"))
    return a.venue_spreads(rows).withColumn("premium_bps", F.round("premium_bps", 4))


@query("wide_merge", f"WITH {TRADES}, {QUOTES}, a AS (SELECT symbol, {bucket_sql(step=24 * HOUR)} AS bucket, CAST(max(price) AS DOUBLE) AS trade_high FROM t GROUP BY 1, 2), b AS (SELECT symbol, {bucket_sql(step=24 * HOUR)} AS bucket, CAST(max(bid_price) AS DOUBLE) AS bid_high FROM q WHERE bid_size > 6 GROUP BY 1, 2) SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.bucket, b.bucket) AS bucket, trade_high, bid_high FROM a FULL JOIN b ON a.symbol = b.symbol AND a.bucket = b.bucket")
def wide_merge(spark, d):
    b = g.ceil_bucket(F.col("us"), START, 24 * HOUR).alias("bucket")
    left = trades(spark, d).groupBy("symbol", b).agg(F.max("price").cast("double").alias("trade_high"))
    right = quotes(spark, d).where("bid_size > 6").groupBy("symbol", b).agg(F.max("bid_price").cast("double").alias("bid_high"))
    return a.wide_merge([left, right], ["symbol", "bucket"]).select("symbol", "bucket", "trade_high", "bid_high")


_STEPS = "s AS (SELECT n_nationkey AS k, CAST(DATE '1994-01-01' + CAST(n_nationkey * 30 + x.i * 600 AS INT) AS DATE) AS d, 1.0 / (1 + x.i + n_nationkey % 3) AS factor FROM nation, (VALUES (0), (1), (2), (3)) AS x(i))"


def _steps(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    return n.select("k", F.date_add(F.lit("1994-01-01").cast("date"), (F.col("k") * 30 + F.col("i") * 600).cast("int")).alias("d"), (1.0 / (1 + F.col("i") + F.col("k") % 3)).alias("factor"))


def _dated_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("k"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_totalprice").cast("double").alias("price"))


@query("step_factor_adjust", f"WITH {_STEPS}, i AS (SELECT k, lag(d) OVER (PARTITION BY k ORDER BY d) AS d0, d, factor FROM s), o AS (SELECT o_orderkey, o_custkey % 25 AS k, CAST(o_orderdate AS DATE) AS dt, CAST(o_totalprice AS DOUBLE) AS price FROM orders) SELECT o_orderkey, round(price * coalesce(factor, 1.0), 4) AS adjusted FROM o LEFT JOIN i ON o.k = i.k AND (d0 IS NULL OR dt > d0) AND dt <= d")
def step_factor_adjust(spark, d):
    rows = a.step_lookup(_dated_orders(spark, d), _steps(spark, d), ["k"], "at", "d", "factor", F.lit(1.0))
    return rows.select("o_orderkey", F.round(F.col("price") * F.col("factor"), 4).alias("adjusted"))


@query("ticker_interval_map", f"WITH {_STEPS}, i AS (SELECT k, d AS d0, coalesce(lead(d) OVER (PARTITION BY k ORDER BY d) - 1, DATE '9999-12-31') AS d1, 'T' || k || '-' || strftime(d, '%Y') AS ticker FROM s) SELECT o_orderkey, ticker FROM (SELECT o_orderkey, o_custkey % 25 AS k, CAST(o_orderdate AS DATE) AS dt FROM orders) o LEFT JOIN i ON o.k = i.k AND dt BETWEEN d0 AND d1")
def ticker_interval_map(spark, d):
    w = Window.partitionBy("k").orderBy("d")
    spans = _steps(spark, d).select("k", F.col("d").alias("d0"), F.coalesce(F.date_sub(F.lead("d").over(w), 1), F.lit("9999-12-31").cast("date")).alias("d1"), F.concat(F.lit("T"), "k", F.lit("-"), F.date_format("d", "yyyy")).alias("ticker"))
    return a.interval_lookup(_dated_orders(spark, d), spans, "k", "at", "d0", "d1", "ticker").select("o_orderkey", "ticker")


@query("rate_lookup_clamp", f"WITH {_STEPS}, r AS (SELECT d, factor FROM s WHERE k = 4), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS at FROM orders) SELECT o_orderkey, round(coalesce(r.factor, (SELECT factor FROM r ORDER BY d LIMIT 1)), 8) AS rate FROM o ASOF LEFT JOIN r ON o.at >= r.d")
def rate_lookup_clamp(spark, d):
    rates = _steps(spark, d).where("k = 4").select("d", "factor")
    rows = a.clamp_lookup(_dated_orders(spark, d).select("o_orderkey", "at"), rates, "at", "d", "factor")
    return rows.select("o_orderkey", F.round("factor", 8).alias("rate"))


@query("feature_catalog")
def feature_catalog(spark, d):
    return f.catalog(spark)
