"""Checks of observation rows; each gives findings: check_id, severity, symbol, message, n, first, last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.running import block_window, in_blocks, own_rows
from quern.shards import SHARD_ROWS

REL, ABS = 1e-9, 1e-12


def close_to(a: Column, b: Column) -> Column:
    """Equal within tolerance, as sums of doubles are."""
    return F.abs(a - b) <= F.greatest(F.lit(ABS), F.lit(REL) * F.greatest(F.abs(a), F.abs(b)))


def findings(rows: DataFrame, check: str, rules: Mapping[str, Column], severity: str = "error", at: str = "bucket") -> DataFrame:
    """Rows that break a rule, counted for each symbol and rule.  A rule holds where it is null."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(m)) for m, ok in rules.items()])
    bad = rows.select("symbol", F.col(at).alias("at"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("message"))
    return bad.groupBy("symbol", "message").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).select(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), "symbol", "message", "n", "first", "last")


def check_flow(rows: DataFrame) -> DataFrame:
    return findings(rows, "flow", {"net flow is not buys less sells": close_to(F.col("net_flow"), F.col("aggressive_buy_volume") - F.col("aggressive_sell_volume")), "negative volume": (F.col("aggressive_buy_volume") >= 0) & (F.col("aggressive_sell_volume") >= 0)})


def check_market_state(rows: DataFrame) -> DataFrame:
    both = (F.col("bid_price") > 0) & (F.col("ask_price") > 0)
    return findings(rows, "market_state", {"crossed": ~both | (F.col("bid_price") <= F.col("ask_price")), "mid is not between bid and ask": ~both | F.col("mid_price").between(F.least("bid_price", "ask_price"), F.greatest("bid_price", "ask_price")), "negative depth": (F.col("bid_depth") >= 0) & (F.col("ask_depth") >= 0), "imbalance out of range": F.col("imbalance").between(-1, 1)})


def check_observation(rows: DataFrame) -> DataFrame:
    some = F.col("trade_count") > 0
    return findings(rows, "observation", {"high below low": ~some | (F.col("high_price") >= F.col("low_price")), "vwap outside of the range": ~some | (F.col("volume") == 0) | F.col("vwap").between(F.col("low_price") - 1e-9, F.col("high_price") + 1e-9), "volume without trades": some | (F.col("volume") == 0)})


def check_numeric(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    fine = lambda c: F.col(c).cast("double")
    return findings(rows, "numeric", {f"{c} is not finite": ~F.isnan(fine(c)) & (F.abs(fine(c)) < 1e300) for c in columns})


def check_degenerate(rows: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Columns that never change over a symbol's rows."""
    g = rows.groupBy("symbol").agg(F.count("*").alias("rows"), *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in columns])
    return g.where(F.col("rows") >= least).select("symbol", "rows", F.explode(each).alias("x")).where("x.lo = x.hi").select(F.lit("degenerate").alias("check_id"), "symbol", F.col("x.column").alias("column"), F.col("x.lo").alias("value"), "rows")


def check_duplicate(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of columns that are equal in all rows of a symbol."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    g = rows.groupBy("symbol").agg(*[F.bool_and(F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("same")) for a, b in pairs])
    return g.select("symbol", F.explode(each).alias("x")).where("x.same").select(F.lit("duplicate").alias("check_id"), "symbol", "x.left", "x.right")


def check_grid(rows: DataFrame, step: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    rows = in_blocks(rows, ["symbol"], "bucket", [], before=1, rows=shard_rows)
    rows = own_rows(rows.withColumn("gap", F.col("bucket") - F.lag("bucket").over(block_window(["symbol"]))))
    return findings(rows, "grid", {"time does not advance": F.col("gap") > 0, "steps are not uniform": F.col("gap") == step, "data from the future": F.col("last_us") <= F.col("bucket")})


def check_freshness(rows: DataFrame) -> DataFrame:
    """Shares of filled and missing rows and the greatest age, of each symbol."""
    q = F.col("data_quality")
    return rows.groupBy("symbol").agg(F.count("*").alias("rows"), F.round(F.avg((q == 1).cast("double")), 6).alias("filled_share"), F.round(F.avg((q == 0).cast("double")), 6).alias("missing_share"), F.max("data_age_ms").alias("max_age_ms")).withColumn("warn", F.col("filled_share") > 0.5)


def check_coverage(rows: DataFrame, start: int, end: int, step: int) -> DataFrame:
    g = rows.where("data_quality = 2").groupBy("symbol").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.count("*").alias("fresh"))
    return g.withColumn("starts_late", F.col("first") > start + step).withColumn("ends_early", F.col("last") < end - step)


#: Findings of one check that a report keeps; the rest are counted in theirs.
REPORTED = 20


def report(all_findings: DataFrame) -> DataFrame:
    """The findings of each check that concern most rows, at most ``REPORTED`` of them: a top-k report."""
    w = Window.partitionBy("check_id").orderBy(F.col("n").desc(), "symbol", "message")
    return all_findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= REPORTED)


def enforce(all_findings: DataFrame, mode: str) -> DataFrame:
    """off: no findings; warn: the report; fail: raises if any is an error."""
    if mode == "off":
        return all_findings.limit(0)
    if mode == "fail":
        worst = all_findings.where("severity = 'error'").groupBy("check_id").agg(F.sum("n").alias("n")).collect()
        if worst:
            raise ValueError("checks failed: " + ", ".join(f"{r['check_id']} ({r['n']})" for r in sorted(worst)))
    return report(all_findings)


def check_unresolved(rows: DataFrame, label: str, most: float = 0.25) -> DataFrame:
    """symbol, share of rows without a label, and whether it is above ``most``."""
    share = F.avg(F.col(label).isNull().cast("double"))
    return rows.groupBy("symbol").agg(share.alias("unresolved_share")).withColumn("warn", F.col("unresolved_share") > most)
