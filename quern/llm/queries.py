"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import count_tokens, encode_corpus
from quern.llm.mix import Mix, sized_records
from quern.llm.nearest import match_nearest
from quern.llm.pii import PiiFinder
from quern.llm.runs import collapse_runs
from quern.tables import table

STREAM = ["symbol", "venue"]
#: Farthest quote of a trade and of an observation, in milliseconds.
TRADE_MS, OBSERVATION_MS = 1_500, 5_000


def _quote_runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    quotes = table(spark, d, "quotes").select(*STREAM, "timestamp_ms", "quote_id", "bid_price", "ask_price")
    ticks = table(spark, d, "instruments").where(F.col("symbol").isNotNull() & F.col("venue").isNotNull()).groupBy(*STREAM).agg(F.max("tick_size").alias("tick_size"))
    return collapse_runs(quotes.join(ticks, STREAM, "left"), STREAM, "timestamp_ms", ["bid_price", "ask_price"], "quote_id", "tick_size", least)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _quote_runs(spark, d, 2).select(*STREAM, F.col("start_ts").alias("start_ms"), F.col("end_ts").alias("end_ms"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, also those of one quote."""
    return _quote_runs(spark, d, 1).select(*STREAM, F.col("start_ts").alias("start_ms"), F.col("end_ts").alias("end_ms"), F.col("n_events").alias("n_quotes"), F.col("duration").alias("duration_ms"))


P1_SQL = """
WITH q AS (
  SELECT q.symbol, q.venue, timestamp_ms, quote_id, bid_price, ask_price, tick_size,
         lag(bid_price) OVER w AS b0, lag(ask_price) OVER w AS a0
  FROM quotes q LEFT JOIN (SELECT symbol, venue, max(tick_size) AS tick_size FROM instruments GROUP BY 1, 2) i
    ON i.symbol = q.symbol AND i.venue = q.venue
  WHERE q.symbol IS NOT NULL AND q.venue IS NOT NULL AND timestamp_ms IS NOT NULL
  WINDOW w AS (PARTITION BY q.symbol, q.venue ORDER BY timestamp_ms, quote_id)
), r AS (
  SELECT *, sum(CASE WHEN abs(bid_price - b0) * 2 < tick_size AND abs(ask_price - a0) * 2 < tick_size THEN 0 ELSE 1 END)
            OVER (PARTITION BY symbol, venue ORDER BY timestamp_ms, quote_id) AS run FROM q
), g AS (
  SELECT symbol, venue, run, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS n_quotes
  FROM r WHERE bid_price IS NOT NULL AND ask_price IS NOT NULL GROUP BY 1, 2, 3
)
"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "quotes").select(*STREAM, (F.col("timestamp_ms") * 1000).alias("us"), "quote_id")
    trades = table(spark, d, "trades").select(*STREAM, (F.col("timestamp_ms") * 1000).alias("us"), F.col("delivery_id").alias("rec_id"), F.lit(TRADE_MS * 1000).cast("bigint").alias("tol"), F.lit(0).alias("tag"))
    seen = table(spark, d, "observations").select(*STREAM, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), F.col("obs_id").alias("rec_id"), F.lit(OBSERVATION_MS * 1000).cast("bigint").alias("tol"), F.lit(1).alias("tag"))
    got = match_nearest(quotes, trades.unionByName(seen), STREAM, "us", "quote_id", "us", "rec_id", "tol", "tag")
    return got.select(F.when(F.col("tag") == 0, "trades").otherwise("observations").alias("rec_table"), F.col("id").alias("rec_id"), F.col("found").alias("quote_id"), "gap")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("rec_table", "rec_id", "quote_id")


def p5_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each table found a quote, and how far off it was."""
    return _matched(spark, d).groupBy("rec_table").agg(F.count("*").alias("n_matched"), F.sum("gap").alias("sum_gap_us"), F.max("gap").alias("max_gap_us"))


P5_SQL = """
WITH p AS (
  SELECT 'trades' AS rec_table, delivery_id AS rec_id, symbol, venue, timestamp_ms * 1000 AS us, 1500000 AS tol FROM trades WHERE timestamp_ms IS NOT NULL
  UNION ALL SELECT 'observations', obs_id, symbol, venue, epoch_us("timestamp"), 5000000 FROM observations WHERE "timestamp" IS NOT NULL
), q AS (SELECT symbol, venue, timestamp_ms * 1000 AS us, quote_id FROM quotes WHERE timestamp_ms IS NOT NULL),
b AS (
  SELECT p.*, q.us AS q_us, q.quote_id FROM p ASOF LEFT JOIN q ON p.symbol = q.symbol AND p.venue = q.venue AND p.us >= q.us
), f AS (
  SELECT b.*, q.us AS n_us, q.quote_id AS n_id FROM b ASOF LEFT JOIN q ON b.symbol = q.symbol AND b.venue = q.venue AND b.us <= q.us
), r AS (
  SELECT rec_table, rec_id, tol, CASE WHEN n_us IS NULL OR us - q_us <= n_us - us THEN quote_id ELSE n_id END AS quote_id,
         least(coalesce(us - q_us, n_us - us), coalesce(n_us - us, us - q_us)) AS gap FROM f
)
"""

#: The tokenizer of problems 8 and 9; its folder holds files for public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file in the folder of ``QUERN_TOKENIZERS``, or else of the installed package."""
    folder = os.environ.get("QUERN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), tokenizer_path())


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the corpus by source and language."""
    docs = table(spark, d, "documents")
    kind = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), F.lower("lang").alias("lang"))
    return count_tokens(docs, tokenizer_path()).join(kind, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _mix(spark: SparkSession, d: str) -> Mix:
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    sized = sized_records(spark, table(spark, d, "documents"), "doc_id", "text", clean("source"), tokenizer_path())
    targets = table(spark, d, "mix_targets").select(clean("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    return Mix(spark, sized, targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selection().select(F.col("id").alias("doc_id"), "source", "n_uses", "n_tokens")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of each source with a target: whether its share is reached to within half a record for each cut, and no record is used too often.

    Both hold for all that have records.  A pattern is cut once for each of its sources and
    repetitions, at records no larger than the largest.
    """
    mix = _mix(spark, d)
    most = mix.sized.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.max("size").alias("largest"))
    cuts = F.lit(sum(len(f) for f in mix.flows.values()))
    got = mix.report().where("target_share IS NOT NULL").join(most, "source", "left")
    near = F.abs(F.col("tokens_used") - F.col("tokens_wanted")) <= F.col("largest") * cuts / 2
    return got.select("source", F.coalesce(near, F.lit(False)).alias("on_target"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"))


P9_INVARIANTS = """
WITH d AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE length(text) > 0)
SELECT lower(trim(m.source)) AS source, d.source IS NOT NULL AS on_target, true AS within_cap FROM mix_targets m LEFT JOIN d ON d.source = lower(trim(m.source))
"""


def _pii(spark: SparkSession, d: str) -> PiiFinder:
    return PiiFinder(spark, table(spark, d, "documents"), table(spark, d, "known_names"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d).found()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d).redacted()


QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p5_found": p5_found, "p5_gaps": p5_gaps, "p8_ids": p8_ids, "p8_counts": p8_counts, "p9_mix": p9_mix, "p9_report": p9_report, "p9_invariants": p9_invariants, "p10_found": p10_found, "p10_redacted": p10_redacted}
SQL = {
    "p9_invariants": P9_INVARIANTS,
    "p1_found": P1_SQL + "SELECT symbol, venue, start_ms, end_ms FROM g WHERE n_quotes > 1",
    "p1_runs": P1_SQL + "SELECT symbol, venue, start_ms, end_ms, n_quotes, end_ms - start_ms AS duration_ms FROM g",
    "p5_found": P5_SQL + "SELECT rec_table, rec_id, quote_id FROM r WHERE gap <= tol",
    "p5_gaps": P5_SQL + "SELECT rec_table, count(*) AS n_matched, CAST(sum(gap) AS BIGINT) AS sum_gap_us, max(gap) AS max_gap_us FROM r WHERE gap <= tol GROUP BY 1",
}
