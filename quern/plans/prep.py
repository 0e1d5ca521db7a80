"""Registered queries of the data-preparation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.changefeed import ChangeFeed, file_stream
from quern.operators.outliers import Readings, flag_outliers
from quern.operators.regrid import READING, regular_grid
from quern.operators.rolling import RollingDays
from quern.operators.upsert import MessageStore, buckets_for
from quern.tables import table

STREAM = ("symbol", "venue")
#: Batches in which deliveries arrive at the message store, and bars at the rolling state.
RUNS, BAR_BATCHES = 3, 3


def _batches(rows: DataFrame, n: int) -> list[tuple[str, DataFrame]]:
    """The rows in order of arrival_ms, in at most n parts of about as many rows each; those without one in the last.

    Rows lie in order of arrival, so each part reads its own part of the files.
    """
    cuts = rows.agg(F.percentile_approx("arrival_ms", F.array(*[F.lit(i / n) for i in range(1, n)]), 1000)).first()[0] or []
    edges, at = [None, *sorted(set(cuts)), None], F.col("arrival_ms")
    out = []
    for a, b in zip(edges, edges[1:]):
        own = F.lit(True) if a is None else at > a
        out.append((f"arrivals {a} to {b}", rows.where(own & (at <= b) if b is not None else own | at.isNull())))
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    quotes = Readings("quotes", table(spark, d, "quotes"), STREAM, "timestamp_ms", "quote_id", ("bid_price", "ask_price"))
    trades = Readings("trades", table(spark, d, "trades"), STREAM, "timestamp_ms", "delivery_id", ("price", "size"), (True, False), F.lower(F.trim("trade_id")))
    return flag_outliers(spark, [quotes, trades])


_P4_STREAM = "PARTITION BY rec_table, field_name, symbol, venue"
P4_SQL = f"""
WITH r AS (
  SELECT 'quotes' AS rec_table, quote_id AS rec_id, symbol, venue, timestamp_ms AS ts, 'bid_price' AS field_name, bid_price AS v, true AS moves, NULL AS mark FROM quotes
  UNION ALL SELECT 'quotes', quote_id, symbol, venue, timestamp_ms, 'ask_price', ask_price, true, NULL FROM quotes
  UNION ALL SELECT 'trades', delivery_id, symbol, venue, timestamp_ms, 'price', price, true, lower(trim(trade_id)) FROM trades
  UNION ALL SELECT 'trades', delivery_id, symbol, venue, timestamp_ms, 'size', size, false, lower(trim(trade_id)) FROM trades
), t AS (SELECT * FROM r WHERE ts IS NOT NULL AND symbol IS NOT NULL AND venue IS NOT NULL),
f1 AS (SELECT *, CASE WHEN v = lag(v) OVER ({_P4_STREAM} ORDER BY ts, rec_id) THEN 0 ELSE 1 END AS fresh FROM t),
f2 AS (SELECT *, sum(fresh) OVER ({_P4_STREAM} ORDER BY ts, rec_id) AS run FROM f1),
f3 AS (SELECT *, count(*) OVER (PARTITION BY rec_table, field_name, symbol, venue, run) AS n FROM f2),
o AS (SELECT *, coalesce(mark, '#' || rec_id) AS k, row_number() OVER ({_P4_STREAM} ORDER BY ts, rec_id) AS place FROM t),
p0 AS (SELECT *, CASE WHEN place - lag(place) OVER c <= 24 THEN 0 ELSE 1 END AS original FROM o WHERE v > 0 WINDOW c AS (PARTITION BY rec_table, field_name, symbol, venue, k, v ORDER BY place)),
p AS (SELECT *, sum(original) OVER (PARTITION BY rec_table, field_name, symbol, venue, k, v ORDER BY place) AS nth FROM p0),
m AS (SELECT *, CAST(v AS DOUBLE) AS x, median(CAST(v AS DOUBLE)) OVER w AS mid, abs(v - lag(v) OVER ({_P4_STREAM} ORDER BY ts, rec_id)) AS step FROM p WHERE original = 1 WINDOW w AS ({_P4_STREAM} ORDER BY ts, rec_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
u AS (SELECT rec_table, field_name, symbol, venue, greatest(24 * 1.4826 * median(abs(x - mid)), 18 * coalesce(median(CAST(step AS DOUBLE)) FILTER (step > 0), 0)) AS usual_reach, median(x) AS usual_value, count(*) AS n FROM m GROUP BY ALL),
h AS (
  SELECT m.*, CASE WHEN moves THEN usual_reach ELSE 63 * usual_value END AS reach, CASE WHEN moves THEN usual_reach > 0 AND abs(x - mid) > usual_reach ELSE x > 64 * usual_value END AS far
  FROM m JOIN u USING (rec_table, field_name, symbol, venue) WHERE u.n >= 3
), g AS (
  SELECT *, CASE WHEN lag(x) OVER w IS NULL OR abs(x - lag(x) OVER w) > reach OR far <> lag(far) OVER w THEN 1 ELSE 0 END AS fresh FROM h WINDOW w AS ({_P4_STREAM} ORDER BY ts, rec_id)
), l AS (SELECT *, sum(fresh) OVER ({_P4_STREAM} ORDER BY ts, rec_id) AS level FROM g),
b AS (SELECT *, count(*) OVER (PARTITION BY rec_table, field_name, symbol, venue, level) AS n FROM l)
SELECT rec_table, rec_id, field_name FROM r WHERE v <= 0
UNION SELECT rec_table, rec_id, field_name FROM f3 WHERE v IS NOT NULL AND n >= 20
UNION SELECT p.rec_table, p.rec_id, p.field_name FROM p JOIN b USING (rec_table, field_name, symbol, venue, k, v, nth) WHERE b.far AND b.n <= 2
"""

#: No interpolation across gaps longer than this.
LONG_GAP_MS = 300_000


def _grid(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "quotes").where(F.col("bid_price") > 0)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    jobs = table(spark, d, "research_jobs").select(F.col("job_id").alias("job"), F.explode(F.array_distinct("symbols")).alias("symbol"), "venue", ms("start_time").alias("start"), ms("end_time").alias("end"), (F.col("observation_interval_seconds") * F.lit(1000).cast("bigint")).alias("step"), F.col("fill_forward").alias("fill"))
    return regular_grid(quotes, STREAM, "timestamp_ms", "quote_id", "bid_price", jobs, LONG_GAP_MS).withColumnsRenamed({"job": "job_id", "grid_ts": "grid_ms"})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where(F.col("status") != READING).select("job_id", "symbol", "grid_ms", "status")


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every grid point with its status, the bid_price in force, and whether it lies in a long gap, which stays marked whatever fills it."""
    return _grid(spark, d).select("job_id", "symbol", "grid_ms", "status", F.col("value").alias("bid_price"), "long_gap")


def p7_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Every grid point with the interpolated bid_price, and whether it lies in a long gap."""
    return _grid(spark, d).select("job_id", "symbol", "grid_ms", F.round("smooth", 8).alias("interpolated"), "long_gap")


P7_SQL = """
WITH j AS (
  SELECT DISTINCT job_id, s.symbol, venue, epoch_ms(start_time) AS t0, epoch_ms(end_time) AS t1, observation_interval_seconds * 1000::BIGINT AS step, coalesce(fill_forward, true) AS fill
  FROM research_jobs, unnest(symbols) AS s(symbol) WHERE observation_interval_seconds > 0
), g AS (
  SELECT job_id, symbol, venue, t0, step, fill, t0 + k * step AS grid_ms FROM j, unnest(range(1, (t1 - t0) // step + 1)) AS x(k)
), q0 AS (SELECT symbol, venue, timestamp_ms AS t, CAST(max_by(bid_price, quote_id) AS DOUBLE) AS y FROM quotes WHERE bid_price > 0 AND timestamp_ms IS NOT NULL GROUP BY 1, 2, 3),
q1 AS (SELECT *, lead(t) OVER w AS t1, lead(y) OVER w AS y1, CAST(lead(t) OVER w - t AS DOUBLE) AS h, (lead(y) OVER w - y) / CAST(lead(t) OVER w - t AS DOUBLE) AS s FROM q0 WINDOW w AS (PARTITION BY symbol, venue ORDER BY t)),
q2 AS (SELECT *, CASE WHEN lag(h) OVER w <= {gap} THEN lag(h) OVER w END AS hl, CASE WHEN lag(h) OVER w <= {gap} THEN lag(s) OVER w END AS sl, CASE WHEN h <= {gap} THEN h END AS hr, CASE WHEN h <= {gap} THEN s END AS sr FROM q1 WINDOW w AS (PARTITION BY symbol, venue ORDER BY t)),
q3 AS (SELECT *, CASE WHEN sl IS NULL THEN coalesce(sr, 0) WHEN sr IS NULL THEN sl WHEN sl * sr > 0 THEN ((2 * hr + hl) + (hr + 2 * hl)) / ((2 * hr + hl) / sl + (hr + 2 * hl) / sr) ELSE 0 END AS m FROM q2),
q AS (SELECT *, lead(m) OVER (PARTITION BY symbol, venue ORDER BY t) AS m1 FROM q3),
a AS (SELECT g.*, q.t, q.y, q.y1, q.h, q.m, q.m1, CAST(g.grid_ms - q.t AS DOUBLE) / q.h AS u FROM g ASOF LEFT JOIN q ON g.symbol = q.symbol AND g.venue = q.venue AND g.grid_ms >= q.t)
, s AS (
  SELECT job_id, symbol, grid_ms, y AS bid, CASE WHEN t > greatest(grid_ms - step, t0) THEN 'reading' WHEN fill AND t > t0 THEN 'filled' ELSE 'missing' END AS status, coalesce(h > {gap} AND t < grid_ms, false) AS long_gap,
         CASE WHEN t = grid_ms THEN y WHEN h <= {gap} THEN y * (1 + 2 * u) * ((1 - u) * (1 - u)) + m * h * u * ((1 - u) * (1 - u)) + y1 * u * u * (3 - 2 * u) + m1 * h * u * u * (u - 1) END AS smooth FROM a
)
""".replace("{gap}", str(LONG_GAP_MS))

def _messages(spark: SparkSession, d: str) -> DataFrame:
    """trade_id null where the feed gave none: such rows can't be told to be copies, and all are kept."""
    rows = table(spark, d, "trades")
    ident = F.nullif(F.lower(F.trim("trade_id")), F.lit(""))
    rows = rows.select(*STREAM, F.coalesce(F.concat(F.lit("id "), ident), F.concat(F.lit("row "), F.col("delivery_id"))).alias("ident"), "delivery_id", "arrival_ms", "timestamp_ms", "price", "size", F.lower("side").alias("side"))
    store = MessageStore(spark, [*STREAM, "ident"], ["arrival_ms", "delivery_id"], ["arrival_ms", "timestamp_ms", "price", "size", "side"], buckets_for(table(spark, d, "trades").count()))
    for name, batch in _batches(rows, RUNS):
        store.upsert(batch, name)
    got = store.compact()
    return got.withColumn("trade_id", F.when(F.col("ident").startswith("id "), F.expr("substring(ident, 4)")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).where((F.col("n_deliveries") > 1) & F.col("trade_id").isNotNull()).select("venue", "symbol", "trade_id")


def p3_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message once; its time is that of the feed, or else of its first arrival."""
    return _messages(spark, d).select("venue", "symbol", "trade_id", F.coalesce("timestamp_ms", "arrival_ms").alias("timestamp_ms"), "price", "size", "side", "n_deliveries")


P3_SQL = """
WITH t AS (
  SELECT venue, symbol, nullif(lower(trim(trade_id)), '') AS trade_id, delivery_id, arrival_ms, timestamp_ms, price, size, lower(side) AS side
  FROM trades WHERE venue IS NOT NULL AND symbol IS NOT NULL
)
"""


def _rolling(spark: SparkSession, d: str) -> RollingDays:
    """The state after the bars' arrivals, in batches of some weeks."""
    state = RollingDays(spark, STREAM, "timestamp_ms", ["arrival_ms", "bar_id"], ["volume", "close"], "volume")
    for name, batch in _batches(table(spark, d, "bars"), BAR_BATCHES):
        state.apply(batch, name)
    return state


def _date(day: str = "day"):
    return F.date_format(F.date_from_unix_date(F.col(day)), "yyyy-MM-dd").alias("bar_date")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).days().where(~F.col("active")).select(*STREAM, _date())


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals of volume, and averages of volume by day and of close by bar, over 7 and 30 days."""
    days = _rolling(spark, d).days()
    first = F.min("day").over(Window.partitionBy(*STREAM))
    out = days.withColumn("age", F.col("day") - first + 1)
    cols = []
    for p in (7, 30):
        cols += [F.col(f"sum_volume_{p}").cast("double").alias(f"volume_{p}d"), F.round(F.col(f"sum_volume_{p}").cast("double") / F.least(F.col("age"), F.lit(p)), 6).alias(f"avg_volume_{p}d"), F.round(F.try_divide(F.col(f"sum_close_{p}").cast("double"), F.col(f"n_close_{p}").cast("double")), 6).alias(f"avg_close_{p}d")]
    return out.select(*STREAM, _date(), *cols)


P2_SQL = """
WITH b AS (
  SELECT symbol, venue, timestamp_ms // 86400000 AS day, volume, close FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, venue, timestamp_ms ORDER BY arrival_ms DESC NULLS LAST, bar_id DESC) AS n FROM bars WHERE timestamp_ms IS NOT NULL)
  WHERE n = 1
), g AS (SELECT symbol, venue, day, sum(volume) AS v, sum(close) AS c, count(close) AS nc, coalesce(bool_or(volume > 0), false) AS active FROM b GROUP BY 1, 2, 3),
s AS (SELECT symbol, venue, min(day) AS d0, max(day) AS d1 FROM g GROUP BY 1, 2),
f AS (
  SELECT s.symbol, s.venue, x.day, x.day - d0 + 1 AS age, coalesce(v, 0) AS v, coalesce(c, 0) AS c, coalesce(nc, 0) AS nc, coalesce(active, false) AS active
  FROM s, unnest(range(d0, d1 + 1)) AS x(day) LEFT JOIN g ON g.symbol = s.symbol AND g.venue = s.venue AND g.day = x.day
)
"""
_P2_PERIOD = "CAST(sum(v) OVER w{p} AS DOUBLE) AS volume_{p}d, round(CAST(sum(v) OVER w{p} AS DOUBLE) / least(age, {p}), 6) AS avg_volume_{p}d, round(CAST(sum(c) OVER w{p} AS DOUBLE) / nullif(CAST(sum(nc) OVER w{p} AS DOUBLE), 0), 6) AS avg_close_{p}d"


def _book(spark: SparkSession, d: str) -> ChangeFeed:
    feed = ChangeFeed(spark, ["symbol", "venue", "side", "price"], ["timestamp_ms", "seq"], ["change_id", "quantity"], (F.lower("action") == "remove") | (F.col("quantity") == 0))
    feed.run(file_stream(spark, f"{d}/book_updates.parquet").withColumn("side", F.lower("side")))
    return feed


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).rows().select("symbol", "venue", "side", "change_id")


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    """The levels that rest in each book at the end, with their quantity."""
    return _book(spark, d).rows().select("symbol", "venue", "side", "price", "quantity", "change_id")


P6_SQL = """
WITH b AS (
  SELECT symbol, venue, lower(side) AS side, price, quantity, change_id, coalesce(lower(action) = 'remove', false) OR coalesce(quantity = 0, false) AS gone,
         row_number() OVER (PARTITION BY symbol, venue, lower(side), price ORDER BY timestamp_ms DESC NULLS LAST, seq DESC NULLS LAST, change_id DESC) AS n
  FROM book_updates
)
"""

QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling, "p3_found": p3_found, "p3_messages": p3_messages, "p4_found": p4_found, "p6_found": p6_found, "p6_levels": p6_levels, "p7_found": p7_found, "p7_grid": p7_grid, "p7_smooth": p7_smooth}
SQL = {
    "p2_found": P2_SQL + "SELECT symbol, venue, strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS bar_date FROM f WHERE NOT active",
    "p2_rolling": P2_SQL + "SELECT symbol, venue, strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS bar_date, " + ", ".join(_P2_PERIOD.format(p=p) for p in (7, 30)) + " FROM f WINDOW w7 AS (PARTITION BY symbol, venue ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY symbol, venue ORDER BY day ROWS 29 PRECEDING)",
    "p3_found": P3_SQL + "SELECT venue, symbol, trade_id FROM t WHERE trade_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "p3_messages": P3_SQL + """
SELECT venue, symbol, trade_id, coalesce(first(timestamp_ms ORDER BY arrival_ms, delivery_id) FILTER (timestamp_ms IS NOT NULL), min(arrival_ms)) AS timestamp_ms,
       first(price ORDER BY arrival_ms, delivery_id) FILTER (price IS NOT NULL) AS price, first(size ORDER BY arrival_ms, delivery_id) FILTER (size IS NOT NULL) AS size,
       first(side ORDER BY arrival_ms, delivery_id) FILTER (side IS NOT NULL) AS side, count(*) AS n_deliveries
FROM t GROUP BY venue, symbol, trade_id, CASE WHEN trade_id IS NULL THEN delivery_id END""",
    "p4_found": P4_SQL,
    "p6_found": P6_SQL + "SELECT symbol, venue, side, change_id FROM b WHERE n = 1 AND NOT gone",
    "p6_levels": P6_SQL + "SELECT symbol, venue, side, price, quantity, change_id FROM b WHERE n = 1 AND NOT gone",
    "p7_found": P7_SQL + "SELECT job_id, symbol, grid_ms, status FROM s WHERE status <> 'reading'",
    "p7_grid": P7_SQL + "SELECT job_id, symbol, grid_ms, status, CASE WHEN status <> 'missing' THEN bid END AS bid_price, long_gap FROM s",
    "p7_smooth": P7_SQL + "SELECT job_id, symbol, grid_ms, round(smooth, 8) AS interpolated, long_gap FROM s",
}
